"""Operators for training-data pipelines: cleaning, scoring, formatting, near copies, mixing, encoding."""
