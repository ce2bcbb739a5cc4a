"""Column expressions: text scalars, hashing, small word tables."""
