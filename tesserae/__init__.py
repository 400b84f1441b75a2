"""tesserae: a PySpark-native engine for change intelligence over transaction, graph, event and text tables."""
