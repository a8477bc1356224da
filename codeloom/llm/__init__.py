"""Operators for training-data pipelines; nothing outside this subpackage needs them."""
