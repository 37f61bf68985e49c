"""Operators that prepare text collections for model training; nothing outside this package imports it."""
