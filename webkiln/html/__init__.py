"""HTML text to node rows."""
