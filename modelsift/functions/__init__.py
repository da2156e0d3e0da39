"""Column expressions: text cleaning, value parsing, ranking and report sentences."""
