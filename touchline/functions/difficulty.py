"""Fixture difficulty and rating formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIFFICULTY_STEP = 0.075
INITIAL_RATING = 1500.0
K_FACTOR = 20.0
HOME_ADVANTAGE = 60.0


def favourable(difficulty: Column, step: float = DIFFICULTY_STEP) -> Column:
    """Above 1 for an easier fixture than average (3)."""
    return 1 + (3 - difficulty) * step


def adverse(difficulty: Column, step: float = DIFFICULTY_STEP) -> Column:
    return 1 + (difficulty - 3) * step


def fixture_scale(difficulty: Column, step: float = DIFFICULTY_STEP) -> Column:
    """Scale for a baseline; an unknown difficulty leaves it unchanged."""
    return favourable(F.coalesce(difficulty, F.lit(3.0)), step)


def elo_expected(own: Column, other: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own) / 400.0))


def rating_difficulty(own: Column, opponent: Column, is_home: bool, advantage: float = HOME_ADVANTAGE) -> Column:
    """1 (easiest) to 5 (hardest) from a rating gap; null if a rating is null."""
    gap = opponent - (own + (advantage if is_home else -advantage))
    raw = 3.0 + gap / 200.0
    return F.when(raw.isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw)))
