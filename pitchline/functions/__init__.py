"""Column expressions: calendar, names, probabilities."""
