"""Operators for large-scale training-data preparation. Nothing else in lectern imports this subpackage."""
