"""tesserae.plans"""
