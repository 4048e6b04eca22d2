"""Column expressions: text, hashing and token arrays."""
