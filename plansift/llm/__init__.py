"""Operators for training-data corpora, each with a query over the given tables."""
