"""Trailing features for every target round at once.

A row's features come from its own player's earlier rows, so "history before
round g" is a window frame that ends one row before the current one. After
the fixture merge a (season, player) holds at most one row per round, which
bounds every window here by the number of rounds in a season.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scoring import RULE, rule, threshold_met, with_rules
from touchline.operators.merge import PLAYER_KEY
from touchline.sources.store import materialize

TRAILING_EVENTS = [
    "goals_scored", "assists", "clean_sheets", "goals_conceded", "saves", "bonus",
    "yellow_cards", "red_cards", "own_goals", "penalties_missed", "penalties_saved",
]
DEFAULT_WINDOW = 5
MINUTES_WINDOW = 3
FORM_DAYS = 30
MINUTES_DEFAULT = {"p_blank": 0.5, "p_short": 0.2, "p_full": 0.3}


def _history(rows: int | None = None, keys: list[str] = PLAYER_KEY):
    start = Window.unboundedPreceding if rows is None else -rows
    return Window.partitionBy(*keys).orderBy("gw").rowsBetween(start, -1)


def trailing_columns(columns: list[str], window: int = DEFAULT_WINDOW) -> dict[str, Column]:
    """Mean over the last `window` rows (not: rows with minutes), and their number."""
    frame = _history(window)
    return {
        **{f"{c}_trailing": F.avg(c).over(frame) for c in columns},
        "n_games": F.count(F.lit(1)).over(frame),
    }


def minutes_columns(window: int = MINUTES_WINDOW, threshold: int = 60) -> dict[str, Column]:
    frame = _history(window)
    m = F.col("minutes")
    share = lambda hit: F.avg(hit.cast("int")).over(frame)
    return {
        "p_blank": share(m == 0),
        "p_short": share((m > 0) & (m < threshold)),
        "p_full": share(m >= threshold),
    }


def with_threshold_hits(df: DataFrame, rules: Mapping) -> DataFrame:
    """`df` plus `_hit`: 1 or 0 where the defensive count is known and has a rule, else null."""
    known = F.col("defensive_contribution").isNotNull() & rule("dc_points").isNotNull()
    return with_rules(df, rules).withColumn("_hit", F.when(known, threshold_met().cast("double"))).drop(RULE)


def threshold_rate(window: int = DEFAULT_WINDOW) -> Column:
    """Share of threshold hits over the last rows whose count is known; of rows `with_threshold_hits`."""
    known = F.collect_list("_hit").over(_history())  # skips nulls; one entry per round at most
    recent = F.slice(known, F.greatest(F.size(known) - (window - 1), F.lit(1)), window)
    total = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(recent)), F.lit(0.0))


def form_column(cutoff: str = "form_cutoff", value: str = "total_points") -> Column:
    """Mean of earlier rows that kicked off after the row's cutoff."""
    earlier = F.collect_list(F.struct(F.col("kickoff_time").alias("k"), F.col(value).alias("v"))).over(_history())
    recent = F.filter(earlier, lambda e: e["k"] > F.col(cutoff))
    total = F.aggregate(recent, F.lit(0).cast("bigint"), lambda a, e: a + e["v"])
    return F.try_divide(total.cast("double"), F.size(recent))


CELL = ["season", "gw", "position", "is_promoted_club"]


def walk_calendar(fact: DataFrame, days: int = FORM_DAYS) -> DataFrame:
    """One row per (season, gw): deadline, when its history was complete, and
    the cutoff of the form window."""
    return calendar_of(fact.withColumns({"_first_kickoff": F.col("kickoff_time"), "_last_kickoff": F.col("kickoff_time")}), days)


def calendar_of(rows: DataFrame, days: int = FORM_DAYS) -> DataFrame:
    """`walk_calendar` from rows or cells with _first_kickoff and _last_kickoff."""
    earlier = Window.partitionBy("season").orderBy("gw").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rows.groupBy("season", "gw").agg(F.min("_first_kickoff").alias("deadline"), F.max("_last_kickoff").alias("_last"))
    return rounds.withColumn("available_at", F.max("_last").over(earlier)).select(
        "season", "gw", "deadline", "available_at",
        (F.col("available_at") - F.expr(f"INTERVAL {days} DAYS")).alias("form_cutoff"),
    )


def cells_of(fact: DataFrame, columns: list[str]) -> DataFrame:
    """Sums, counts and kickoffs per (season, gw, position, promoted): all that pools and calendar need, a handful of rows per round."""
    return fact.groupBy(*CELL).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns],
        F.min("kickoff_time").alias("_first_kickoff"), F.max("kickoff_time").alias("_last_kickoff"),
    )


def expanding_pools(fact: DataFrame, columns: list[str]) -> DataFrame:
    """Prior means before each round: one row per (season, gw, position, promoted).

    `<c>_prior` is the mean of the row's (position, promoted) peers in earlier
    rounds, else of its position, else 0. Sums and counts are taken per round
    first, so the running part works on a handful of rows per round.
    """
    return pools_of(cells_of(fact, columns), columns)


def pools_of(cells: DataFrame, columns: list[str]) -> DataFrame:
    peers = (
        Window.partitionBy("season", "position", "is_promoted_club").orderBy("gw").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Range frame: both promoted cells of one round belong to the same step.
    position = Window.partitionBy("season", "position").orderBy("gw").rangeBetween(Window.unboundedPreceding, -1)
    mean = lambda c, w: F.try_divide(F.sum(f"_s_{c}").over(w), F.sum(f"_n_{c}").over(w))
    return cells.select(
        *CELL, *[F.coalesce(mean(c, peers), mean(c, position), F.lit(0.0)).alias(f"{c}_prior") for c in columns],
    )


def fill_with_pools(df: DataFrame, pools: DataFrame, columns: list[str]) -> DataFrame:
    """Fill missing trailing values from the priors; never leaves a null."""
    joined = df.join(pools, ["season", "gw", "position", "is_promoted_club"], "left")
    filled = {
        f"{c}_trailing": F.coalesce(F.col(f"{c}_trailing"), F.col(f"{c}_prior"), F.lit(0.0)) for c in columns
    }
    return joined.withColumns(filled).drop(*[f"{c}_prior" for c in columns])


def trailing_mean(fact: DataFrame, columns: list[str], window: int = DEFAULT_WINDOW) -> DataFrame:
    return fact.withColumns(trailing_columns(columns, window))


def trailing_feature(fact: DataFrame, columns: list[str], window: int = DEFAULT_WINDOW) -> DataFrame:
    """Trailing means with the pooled prior filling the gaps.

    The cells are stored before the join, so that their size is known and the fact
    is not exchanged for them.
    """
    pools = pools_of(materialize(cells_of(fact, columns)), columns)
    return fill_with_pools(trailing_mean(fact, columns, window), pools, columns)


def minutes_distribution(fact: DataFrame, window: int = MINUTES_WINDOW, threshold: int = 60) -> DataFrame:
    return fact.withColumns(minutes_columns(window, threshold))


def trailing_state(fact: DataFrame, upto_gw: int, columns: list[str], window: int = DEFAULT_WINDOW) -> DataFrame:
    """One target only: the trailing means per player after round `upto_gw`."""
    newest = Window.partitionBy(*PLAYER_KEY).orderBy(F.col("gw").desc())
    kept = fact.filter(F.col("gw") <= upto_gw).withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= window)
    return kept.groupBy(*PLAYER_KEY).agg(
        *[F.avg(c).alias(f"{c}_trailing") for c in columns], F.count(F.lit(1)).alias("n_games")
    )
