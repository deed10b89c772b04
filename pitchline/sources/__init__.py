"""Reading results, fixtures and prediction documents, and writing tables, models and reports."""
