"""Operators of a training-data pipeline: filtering, near duplicates, media, tokens, mixing, packing."""
