"""Two-sided contest analytics on Spark: ingestion, leakage-safe features, scoring models, evaluation."""
