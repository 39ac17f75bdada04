"""Column functions: text, names, scores and dates."""
