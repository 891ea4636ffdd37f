"""Search and index maintenance on streams."""
