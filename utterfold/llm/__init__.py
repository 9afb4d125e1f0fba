"""Operators for training-data pipelines: filters, deduplication, tokens, shards."""
