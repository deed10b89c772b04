"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this subpackage imports it.  Each operator lives
in a module of its own; ``registry`` lists the queries and their SQL.
"""
