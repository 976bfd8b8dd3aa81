"""Relational operators of code and text retrieval."""
