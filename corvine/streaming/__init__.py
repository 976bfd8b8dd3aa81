"""Structured Streaming over file changes."""
