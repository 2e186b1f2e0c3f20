"""Operators on text corpora for training data, one module each."""
