"""Incremental reconciliation as a structured stream."""
