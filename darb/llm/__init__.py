"""Operators for training-data pipelines: percentiles, tokenizing, leakage search, language labels."""
