"""Triples from N-Triples text and from relational tables."""
