"""Column functions: text, amounts, dates, distances, hashes and token arrays."""
