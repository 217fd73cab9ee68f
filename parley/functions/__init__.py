"""Column functions: times and sizes, words, names and keys."""
