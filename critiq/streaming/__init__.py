"""Review operators on streams."""
