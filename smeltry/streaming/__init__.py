"""Structured Streaming operators; most of them also run on batches."""
