"""Operators on text corpora for training data.  Nothing outside this package imports it."""
