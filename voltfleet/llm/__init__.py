"""Operators of a training-data pipeline: counting, judging, deduplicating, mixing and packing documents."""
