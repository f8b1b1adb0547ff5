"""Operators for training-data pipelines: deduplication, tokens, packing, extraction, quality, language models."""
