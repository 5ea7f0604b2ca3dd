"""Column functions: text folding, checksums, candidate sets."""
