"""Operators of a training-data pipeline: dedup, packing, mixing, scoring, filtering."""
