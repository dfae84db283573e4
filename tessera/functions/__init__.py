"""Column expressions: text, paths, time, numbers and search scores."""
