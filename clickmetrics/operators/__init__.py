"""Metric operators: each a DataFrame -> DataFrame function over the web tables."""
