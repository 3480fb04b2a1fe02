"""Corpus operators for training data: each takes DataFrames and returns DataFrames."""
