"""Column expressions: casts, vectors, bins and text, all built-in Spark functions."""
