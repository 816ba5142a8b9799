"""The interval engine on streams."""
