"""tesserae.sources"""
