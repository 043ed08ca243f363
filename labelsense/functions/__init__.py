"""Column expressions: text, vectors, hash buckets."""
