"""Structured Streaming over change journals."""
