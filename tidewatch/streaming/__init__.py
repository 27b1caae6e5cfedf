"""The same transformations on streams."""
