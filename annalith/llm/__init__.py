"""Operators for large text collections used as training data. Nothing outside this subpackage imports it."""
