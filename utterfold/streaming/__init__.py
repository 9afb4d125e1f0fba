"""Structured Streaming: incremental corpora and request scoring."""
