"""Ranks and quantiles over groups of any size.

Rows are first reduced to distinct values with counts (on the map side). The
counts are dealt by ranges of (group, value), so the borders come from the data:
a task gets about as many distinct values as any other, whatever their scale and
however large a group is. Values are put in order inside a task; of each task
only a group's total is ordered over the whole group. Results are exact, and a
null key is a group of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.store import materialize


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, null being equal to null; the columns come from `left`."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in on])


def cumulative_counts(counts: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """`counts` (one row per group and distinct value) plus the group's running
    count up to and including the value (`upto`) and its whole count (`total`).

    The dealt counts are stored, because later steps must find each value in the
    task where its range put it.
    """
    order = [F.col(c).asc_nulls_first() for c in [*keys, value]]
    dealt = materialize(counts.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()))
    inside = Window.partitionBy("_task", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*keys)
    before = F.sum("_n").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        dealt.groupBy("_task", *keys)
        .agg(F.sum(n).alias("_n"))
        .select("_task", *keys, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("total"))
    )
    running = dealt.withColumn("_in", F.sum(n).over(inside))
    return (
        join_null_safe(running, offsets, ["_task", *keys])
        .withColumn("upto", F.col("_before") + F.col("_in"))
        .drop("_task", "_in", "_before")
    )


def average_ranks(counts: DataFrame, keys: list[str], value: str, n: str = "n", out: str = "avg_rank") -> DataFrame:
    """One row per group and value with its rank, ties averaged."""
    ranked = cumulative_counts(counts, keys, value, n)
    return ranked.select(*keys, value, (F.col("upto") - (F.col(n) - 1) / 2.0).alias(out))


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """`df` plus the average-tie rank of `value` inside its group; null for a null value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return join_null_safe(df, average_ranks(counts, keys, value, out=out), [*keys, value], "left")


def quantile_bins(counts: DataFrame, keys: list[str], value: str, n_bins: int, n: str = "n") -> DataFrame:
    """`counts` plus `bin`, the number of the group's n_bins - 1 inner quantiles below the value.

    The quantile of p lies between the values at the two positions around
    p * (total - 1); it is below a value exactly if the lower of them comes before
    the value's first position. So bins need positions only, no quantile.
    """
    running = cumulative_counts(counts, keys, value, n)
    first = F.col("upto") - F.col(n)
    below = [(F.floor(F.lit(i / n_bins) * (F.col("total") - 1)) < first).cast("int") for i in range(1, n_bins)]
    return running.withColumn("bin", reduce(lambda a, b: a + b, below, F.lit(0))).drop("upto", "total")


def quantile_breaks(counts: DataFrame, keys: list[str], value: str, probabilities: list[float], n: str = "n") -> DataFrame:
    """Per group the linearly interpolated quantiles, as array `breaks`."""
    placed = cumulative_counts(counts, keys, value, n).withColumn("_from", F.col("upto") - F.col(n))
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    # Each probability needs the values at two neighbouring positions; keep the
    # values that sit at one of them.
    spot = F.transform(wanted, lambda p: p * (F.col("total") - 1))
    needed = F.flatten(
        F.transform(spot, lambda s, i: F.array(
            F.struct(i.alias("i"), F.lit(0).alias("hi"), F.floor(s).alias("at"), (s - F.floor(s)).alias("frac")),
            F.struct(i.alias("i"), F.lit(1).alias("hi"), F.ceil(s).alias("at"), (s - F.floor(s)).alias("frac")),
        ))
    )
    here = F.filter(needed, lambda e: (e["at"] >= F.col("_from")) & (e["at"] < F.col("upto")))
    hits = placed.select(*keys, F.col(value).cast("double").alias("_v"), F.explode(here).alias("e"))
    per_break = hits.groupBy(*keys, F.col("e.i").alias("_i")).agg(
        F.max(F.when(F.col("e.hi") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("e.hi") == 1, F.col("_v"))).alias("_up"),
        F.max("e.frac").alias("_frac"),
    )
    point = F.col("_lo") + (F.col("_up") - F.col("_lo")) * F.col("_frac")
    ordered = F.array_sort(F.collect_list(F.struct("_i", point.alias("b"))))  # one entry per probability
    return per_break.groupBy(*keys).agg(F.transform(ordered, lambda e: e["b"]).alias("breaks"))
