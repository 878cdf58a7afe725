"""Operators of a training-data pipeline: cleaning, deduplication, tokenising and packing of documents."""
