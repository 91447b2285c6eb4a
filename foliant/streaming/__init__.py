"""streaming of the document engine."""
