"""Operators for training-data pipelines; nothing outside this package imports it."""
