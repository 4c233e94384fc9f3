"""Ordered per-key work that survives a hot key.

A window over a key puts all rows of that key into one task. Here each key is
cut into time segments: rows are ordered inside (key, segment), and only one
summary row per segment is ordered over the whole key to carry the state
across segment borders. The result is the same as the plain window.

`segment` is a `date_trunc` unit; pick it so that one segment of the hottest
key fits a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEGMENT = "hour"


def _place(keys: list[str], segment: str, ts: str) -> Column:
    """Key and segment as one struct. Structs compare null fields as equal, so
    rows with a null key form a group of their own; null times come first."""
    return F.struct(F.struct(*keys).alias("key"), F.date_trunc(segment, F.col(ts)).alias("seg"))


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], payload: list[str], out: str = "_previous", segment: str = DEFAULT_SEGMENT
) -> DataFrame:
    """`df` plus struct `out`: `payload` of the key's previous row, null on the first.

    `order[0]` is the timestamp that is cut into segments.
    """
    cut = df.withColumn("_at", _place(keys, segment, order[0]))
    state = F.struct(*payload)
    inside = Window.partitionBy("_at").orderBy(*order)
    rows = cut.withColumns({out: F.lag(state).over(inside), "_rn": F.row_number().over(inside)})
    carried = (
        cut.groupBy("_at")
        .agg(F.max_by(state, F.struct(*order)).alias("_last"))
        .select("_at", F.lag("_last").over(Window.partitionBy("_at.key").orderBy("_at.seg")).alias("_carry"))
    )
    joined = rows.join(carried, "_at", "left")
    previous = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col(out))
    return joined.withColumn(out, previous).drop("_at", "_rn", "_carry")


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    payload: list[str],
    tie: list[str] | None = None,
    segment: str = DEFAULT_SEGMENT,
) -> DataFrame:
    """Left join: for each left row the key's latest right row at or before it.

    Right columns arrive in the struct `matched`, null where there is none.
    `tie` orders right rows that share a timestamp.
    """
    tie = tie or []
    state = F.struct(right_ts, *payload)
    probes = left.select(
        *keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"),
        F.struct(*left.columns).alias("_left"),
    )
    facts = right.select(
        *keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
        state.alias("_right"), F.struct(*tie).alias("_tie") if tie else F.lit(None).cast("int").alias("_tie"),
    )
    both = probes.unionByName(facts, allowMissingColumns=True).withColumn("_at", _place(keys, segment, "_ts"))
    inside = Window.partitionBy("_at").orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(inside))
    over_segments = Window.partitionBy("_at.key").orderBy("_at.seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        both.groupBy("_at")
        .agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_ts", "_tie"))).alias("_last"))
        .select("_at", F.last("_last", ignorenulls=True).over(over_segments).alias("_carry"))
    )
    matched = running.filter(F.col("_side") == 1).join(carried, "_at", "left")
    return matched.select("_left.*", F.coalesce("_seen", "_carry").alias("matched"))
