"""Column expressions: paths, text, vectors, stemming."""
