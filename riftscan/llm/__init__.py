"""Operators for large training-data sets. Nothing outside this subpackage imports it."""
