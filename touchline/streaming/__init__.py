"""Structured Streaming versions of the snapshot operators."""
