"""Scalar conversions and field transformers, as Columns."""
