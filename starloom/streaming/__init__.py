"""Structured Streaming feeds reusing the batch plans."""
