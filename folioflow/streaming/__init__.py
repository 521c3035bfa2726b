"""Structured Streaming over job progress lines."""
