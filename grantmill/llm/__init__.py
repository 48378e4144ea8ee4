"""Operators of a training-data pipeline: scoring, tokens, duplicates, packing, search."""
