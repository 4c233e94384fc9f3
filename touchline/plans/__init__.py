"""Composed plans: models, walk-forward evaluation, reports."""
