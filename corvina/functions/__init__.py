"""Column expressions: text, vectors, label paths and text-search analysis."""
