"""Operators of a training-data pipeline: scoring, cleaning, deduplication, search, mixing, packing."""
