"""Structured Streaming versions of the workflows."""
