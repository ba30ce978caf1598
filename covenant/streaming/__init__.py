"""The write gate on streams."""
