"""Operators for preparing training data from code-review data."""
