"""Corpus files in, results out."""
