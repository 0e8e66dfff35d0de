"""Column expressions: text, vector, identifier and rounding rules."""
