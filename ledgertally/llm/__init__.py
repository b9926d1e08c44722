"""Operators of a training-data pipeline: dedup, mixing, scoring, filtering, token counts and packing of documents."""
