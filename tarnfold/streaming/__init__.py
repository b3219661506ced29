"""Continuous indexing."""
