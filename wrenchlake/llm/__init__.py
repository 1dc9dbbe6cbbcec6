"""Operators for building training data out of raw pages, texts and vectors."""
