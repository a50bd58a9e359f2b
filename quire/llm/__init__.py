"""Operators for building training corpora. Nothing else in quire imports this package."""
