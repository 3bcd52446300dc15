"""Column expressions and argument parsers."""
