"""Snapshot series: change capture, latest state, state as of, deltas."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.segments import DEFAULT_SEGMENT, with_previous
from touchline.operators.validation import require_columns

NUMERIC_COLUMNS = [
    "now_cost", "selected_by_percent", "transfers_in_event", "transfers_out_event",
    "form", "chance_of_playing_next_round", "ep_next",
]
CONTEXT_COLUMNS = ["status", "news_added"]
TRACKED_COLUMNS = [
    "now_cost", "selected_by_percent", "transfers_in_event", "transfers_out_event",
    "form", "status", "chance_of_playing_next_round", "news_added", "ep_next",
]


def changed_rows(
    snapshots: DataFrame,
    columns: list[str] = TRACKED_COLUMNS,
    partition: tuple[str, ...] = ("gw",),
    key: str = "element_id",
    order: tuple[str, ...] = ("snapshot_ts",),
    segment: str = DEFAULT_SEGMENT,
) -> DataFrame:
    """Rows whose tracked columns differ from the key's previous snapshot.

    A key's first row in a partition always stays: it is the baseline.
    """
    require_columns(snapshots, key, *columns, *partition, *order)
    seen = with_previous(snapshots, [*partition, key], list(order), columns, segment=segment)
    same = F.struct(*columns).eqNullSafe(F.col("_previous"))
    return seen.filter(F.col("_previous").isNull() | ~same).drop("_previous")


def compare_state(new: DataFrame, previous: DataFrame, columns: list[str] = TRACKED_COLUMNS, key: str = "element_id") -> DataFrame:
    """Rows of one new snapshot that differ from a stored state (one row per key)."""
    before = previous.select(key, F.struct(*columns).alias("_previous"))
    joined = new.join(before, key, "left")
    same = F.struct(*columns).eqNullSafe(F.col("_previous"))
    return joined.filter(F.col("_previous").isNull() | ~same).select(*new.columns)


def latest_state(snapshots: DataFrame, keys: list[str] | str = "element_id", order: tuple[str, ...] = ("snapshot_ts",)) -> DataFrame:
    """The latest row per key; an aggregate, so nothing is sorted."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in snapshots.columns if c not in keys]
    latest = snapshots.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return latest.select(*keys, "_row.*").select(*snapshots.columns)


def _moment(df: DataFrame, column: str, when: datetime) -> Column:
    """A literal of the column's own type, so the comparison reaches the scan."""
    return F.lit(when).cast(df.schema[column].dataType)


def state_as_of(
    snapshots: DataFrame, as_of: datetime, keys: list[str] | str = "element_id", order: tuple[str, ...] = ("snapshot_ts",)
) -> DataFrame:
    return latest_state(snapshots.filter(F.col(order[0]) <= _moment(snapshots, order[0], as_of)), keys, order)


def reference_times(as_of: datetime, deadline: datetime | None = None) -> dict[str, datetime]:
    times = {f"{h}h": as_of - timedelta(hours=h) for h in (1, 24, 72)}
    if deadline is not None:
        times["since_gw"] = deadline
    return times


def _at(columns: list[str], limit: Column, order: tuple[str, ...]) -> Column:
    """Aggregate: the columns of the latest row at or before `limit`."""
    reached = F.when(F.col(order[0]) <= limit, F.struct(*order))
    return F.max_by(F.struct(*columns), reached)


def compute_deltas(
    snapshots: DataFrame,
    as_of: datetime,
    references: Mapping[str, datetime],
    key: str = "element_id",
    order: tuple[str, ...] = ("snapshot_ts",),
    columns: list[str] | None = None,
) -> DataFrame:
    """Current state and its difference to each reference time, in one scan.

    A delta is null, never zero, for a key with no row by the reference time.
    """
    columns = columns or NUMERIC_COLUMNS
    context = [c for c in CONTEXT_COLUMNS if c in snapshots.columns]
    at = lambda when: _moment(snapshots, order[0], when)
    seen = snapshots.filter(F.col(order[0]) <= at(as_of))
    states = seen.groupBy(key).agg(
        F.max_by(F.struct(*columns, *context), F.struct(*order)).alias("_now"),
        *[_at(columns, at(when), order).alias(f"_at_{label}") for label, when in references.items()],
    )
    deltas = [
        (F.col(f"_now.{c}") - F.col(f"_at_{label}.{c}")).alias(f"{c}_delta_{label}")
        for label in references
        for c in columns
    ]
    return states.select(key, "_now.*", *deltas)


def state_pair(
    snapshots: DataFrame,
    before: datetime,
    after: datetime,
    columns: list[str],
    key: str = "element_id",
    order: tuple[str, ...] = ("snapshot_ts",),
) -> DataFrame:
    """States at two instants, for keys known at both, in one scan."""
    at = lambda when: _moment(snapshots, order[0], when)
    seen = snapshots.filter(F.col(order[0]) <= at(max(before, after)))
    pair = seen.groupBy(key).agg(_at(columns, at(before), order).alias("_b"), _at(columns, at(after), order).alias("_a"))
    return pair.filter(F.col("_b").isNotNull() & F.col("_a").isNotNull()).select(
        key,
        *[F.col(f"_b.{c}").alias(f"{c}_before") for c in columns],
        *[F.col(f"_a.{c}").alias(f"{c}_after") for c in columns],
    )


def retention_filter(df: DataFrame, ts: str, days: int, now: datetime) -> DataFrame:
    """Keep rows not older than `days`; an unknown time is kept."""
    cutoff = _moment(df, ts, now - timedelta(days=days))
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= cutoff))
