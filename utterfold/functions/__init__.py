"""Column functions: text, vectors, ranked predictions."""
