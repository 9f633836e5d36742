"""Operators for training-data pipelines (deduplication, filtering, extraction, tokens, packing)."""
