"""Operators for large training-data pipelines; nothing outside this sub-package imports it."""
