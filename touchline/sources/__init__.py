"""Readers, payload flatteners and append-only tables."""
