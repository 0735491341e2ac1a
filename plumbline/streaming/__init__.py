"""Structured Streaming over the inspection log."""
