"""Structured Streaming over the action log."""
