"""Sources and sinks of fixed-width binary records."""
