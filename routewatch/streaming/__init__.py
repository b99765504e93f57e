"""Structured Streaming twins of the batch analyses."""
