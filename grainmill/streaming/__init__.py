"""The conversion on streams."""
