"""Operators for training data: search, near duplicates, scoring, mixing, packing, formatting and the like."""
