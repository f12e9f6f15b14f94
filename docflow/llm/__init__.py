"""Training-data operators; nothing else in docflow imports this subpackage."""
