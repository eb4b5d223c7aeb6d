"""Operators of a training-data pipeline: sharding, de-duplication, extraction, filtering, mixing, scoring, formatting."""
