"""Relational operators: cleaning, form, rating, scores, fuzzy inference, metrics, splits, prediction, reconciliation."""
