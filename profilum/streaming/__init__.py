"""Structured Streaming upkeep of the batch results."""
