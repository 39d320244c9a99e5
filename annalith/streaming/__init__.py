"""Incremental forms of the analyses."""
