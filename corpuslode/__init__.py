"""Corpus retrieval, term extraction and evaluation as DataFrame transformations."""
