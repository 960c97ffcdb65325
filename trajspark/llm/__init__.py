"""Operators of a training-data pipeline: quality, extraction, secrets, licences, tokens, search, dedup, packing."""
