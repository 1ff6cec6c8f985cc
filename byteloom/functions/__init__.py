"""Column functions over bytes and UTF-8 text."""
