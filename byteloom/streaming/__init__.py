"""The column functions on streams."""
