"""Operators of a training-data pipeline: near-duplicates, sharding, mixing, filters, formatting."""
