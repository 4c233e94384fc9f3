"""Metrics over walk-forward results.

`keys` are the grouping columns. Undefined values are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.market import binomial_ci
from touchline.functions.scoring import COMPONENTS
from touchline.operators.ranks import average_ranks, join_null_safe, quantile_bins
from touchline.sources.store import materialize

EVENT_BUCKETS: dict[str, str] = {
    "blank_(0_minutes)": "minutes = 0",
    "played_no_goal_involvement": "minutes > 0 AND goals_scored = 0 AND assists = 0",
    "goal_involvement": "goals_scored > 0 OR assists > 0",
    "clean_sheet": "clean_sheets > 0",
    "bonus_earned": "bonus > 0",
}
POOLED = "pooled"


def error_metrics(results: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("error")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def pearson(df: DataFrame, x: str, y: str, keys: list[str], out: str = "pearson") -> DataFrame:
    """Correlation per group, in one pass; a null key is a group of its own.

    The moments keep running means, so large offsets lose no digits. A group
    without spread has no correlation: that is read off its extremes, which are
    exact. Not `corr`: it divides by zero on such a group before any guard.
    """
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    spread = (F.max(xx) > F.min(xx)) & (F.max(yy) > F.min(yy))
    rows = df.filter(xx.isNotNull() & yy.isNotNull())
    return rows.groupBy(*keys).agg(F.when(spread, F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))).alias(out))


def _pair_counts(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n"))


def _spearman_of_counts(pairs: DataFrame, x: str, y: str, keys: list[str], out: str) -> DataFrame:
    count = lambda v: pairs.groupBy(*keys, v).agg(F.sum("n").alias("n"))
    ranked = join_null_safe(pairs, average_ranks(count(x), keys, x, out="_rx"), [*keys, x])
    ranked = join_null_safe(ranked, average_ranks(count(y), keys, y, out="_ry"), [*keys, y])
    # The mean of average-tie ranks is (N + 1) / 2 by construction, so the
    # centred sums follow from three weighted sums in one aggregation.
    w = F.col("n").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("_n"),
        F.sum(w * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(w * F.col("_ry") * F.col("_ry")).alias("_yy"),
        F.min("_rx").alias("_x0"), F.max("_rx").alias("_x1"), F.min("_ry").alias("_y0"), F.max("_ry").alias("_y1"),
    )
    n = F.col("_n")
    m = n * (n + 1) * (n + 1) / 4.0
    value = (F.col("_xy") - m) / F.sqrt((F.col("_xx") - m) * (F.col("_yy") - m))
    spread = (F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0"))
    return sums.select(*keys, F.when(spread, value).alias(out))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], out: str = "spearman") -> DataFrame:
    """Pearson of average-tie ranks, on pre-counted value pairs."""
    return _spearman_of_counts(materialize(_pair_counts(df, x, y, keys)), x, y, keys, out)


def _with_mean(per_position: DataFrame, keys: list[str], within: str) -> DataFrame:
    mean = per_position.groupBy(*keys).agg(F.avg("spearman").alias("spearman")).withColumn(within, F.lit("mean"))
    return per_position.unionByName(mean)


def spearman_within(
    results: DataFrame, keys: list[str], within: str = "position", x: str = "prediction", y: str = "total_points"
) -> DataFrame:
    """Per position, plus the unweighted mean of the defined ones."""
    rows = results.filter(F.col(within).isNotNull())
    return _with_mean(spearman(rows, x, y, [*keys, within]), keys, within)


def calibration(results: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """Prediction quantile bins: mean prediction, mean actual, size.

    Bins are closed on the right; equal breaks leave empty bins, which vanish.
    """
    counts = results.groupBy(*keys, "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_points").alias("_actual")
    )
    return _calibration_of_counts(counts, keys, n_bins)


def _calibration_of_counts(counts: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    binned = quantile_bins(counts.filter(F.col("prediction").isNotNull()), keys, "prediction", n_bins)
    return binned.groupBy(*keys, "bin").agg(
        F.try_divide(F.sum(F.col("prediction") * F.col("n")), F.sum("n")).alias("mean_prediction"),
        F.try_divide(F.sum("_actual"), F.sum("n")).alias("mean_actual"),
        F.sum("n").alias("n"),
    )


def tally(results: DataFrame) -> DataFrame:
    """Walk-forward results reduced to what every report metric needs.

    One row per season, model, position, prediction and actual, with the number
    of rows and of rows per kind of outcome. One pass, combined on the map side;
    all later steps read this much smaller table.
    """
    return results.groupBy("season", "baseline", "position", "prediction", "total_points").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(p)).alias(f"n_{i}") for i, p in enumerate(EVENT_BUCKETS.values())]
    )


def _with_pooled(counts: DataFrame, measures: list[str]) -> DataFrame:
    """Counts per season, and again over all seasons."""
    keys = [c for c in counts.columns if c not in measures and c != "season"]
    pooled = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures]).withColumn("season", F.lit(POOLED))
    return counts.unionByName(pooled)


def error_by_event(results: DataFrame, keys: list[str]) -> DataFrame:
    """MAE over five overlapping kinds of outcome, in long form."""
    e = F.abs("error")
    wide = results.groupBy(*keys).agg(
        *[F.sum(F.when(F.expr(p), e)).alias(f"abs_{i}") for i, p in enumerate(EVENT_BUCKETS.values())],
        *[F.count_if(F.expr(p)).alias(f"n_{i}") for i, p in enumerate(EVENT_BUCKETS.values())],
    )
    return _event_rows(wide, keys)


def _event_rows(wide: DataFrame, keys: list[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(label).alias("bucket"), F.try_divide(f"abs_{i}", f"n_{i}").alias("mae"), F.col(f"n_{i}").alias("n"))
        for i, label in enumerate(EVENT_BUCKETS)
    ]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")


def _error_sums(tallies: DataFrame) -> DataFrame:
    """Error sums per (season, model), and per model over all seasons."""
    e, n = F.abs(F.col("prediction") - F.col("total_points")), F.col("n")
    buckets = range(len(EVENT_BUCKETS))
    sums = tallies.groupBy("season", "baseline").agg(
        F.sum("n").alias("n"), F.sum(e * n).alias("_abs"), F.sum(e * e * n).alias("_sq"),
        *[F.sum(e * F.col(f"n_{i}")).alias(f"abs_{i}") for i in buckets], *[F.sum(f"n_{i}").alias(f"n_{i}") for i in buckets],
    )
    return _with_pooled(sums, [c for c in sums.columns if c not in ("season", "baseline")])


def _summary_of(tallies: DataFrame) -> DataFrame:
    errors = _error_sums(tallies).select(
        "season", "baseline", "n", F.try_divide("_abs", "n").alias("mae"), F.sqrt(F.try_divide("_sq", "n")).alias("rmse")
    )
    pairs = tallies.filter(F.col("position").isNotNull()).select("season", "baseline", "position", "prediction", "total_points", "n")
    levels = materialize(_with_pooled(pairs, ["n"]))
    ranks = _spearman_of_counts(levels, "prediction", "total_points", ["season", "baseline", "position"], "spearman")
    mean = ranks.groupBy("season", "baseline").agg(F.avg("spearman").alias("spearman_mean"))
    return join_null_safe(errors, mean, ["season", "baseline"], "left")


def summarize(results: DataFrame) -> DataFrame:
    """Error and rank metrics per (season, model) and per model, in one table.

    Ranks depend on the level, so the pre-counted pairs of both levels are
    ranked in one pass.
    """
    return _summary_of(materialize(tally(results)))


def component_mae(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute gap between predicted and realised points per component."""
    gaps = [F.avg(F.abs(F.col(f"predicted_{c}") - F.col(f"actual_{c}"))).alias(c) for c in COMPONENTS]
    wide = rows.groupBy(*keys).agg(*gaps) if keys else rows.agg(*gaps)
    return wide.unpivot(keys, list(COMPONENTS), "component", "mae")


def minutes_scorecard(rows: DataFrame, keys: list[str], threshold: int = 60) -> DataFrame:
    """Brier score of each minutes outcome and the error of expected minutes."""
    m = F.col("minutes")
    brier = lambda p, hit: F.avg(F.pow(F.col(p) - hit.cast("double"), F.lit(2.0)))
    expected = F.col("p_short") * (threshold / 2) + F.col("p_full") * 90
    return rows.groupBy(*keys).agg(
        brier("p_blank", m == 0).alias("brier_blank"),
        brier("p_short", (m > 0) & (m < threshold)).alias("brier_short"),
        brier("p_full", m >= threshold).alias("brier_full"),
        F.avg(F.abs(expected - m)).alias("mae_expected_minutes"),
        F.count(F.lit(1)).alias("n"),
    )


def hit_rate(rows: DataFrame, predicted: str = "predicted_direction", actual: str = "actual_direction") -> DataFrame:
    """Of the players predicted to move, how many moved that way; one row."""
    moved = F.col(predicted) != "stable"
    counted = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(moved).alias("n_moves_predicted"),
        F.count_if(moved & (F.col(predicted) == F.col(actual))).alias("hits"),
    )
    n = F.col("n_moves_predicted")
    low, high = binomial_ci(F.col("hits"), n)
    return counted.select(
        "n", "n_moves_predicted",
        F.try_divide("hits", n).alias("hit_rate"),
        F.when(n > 0, low).alias("ci_low"),
        F.when(n > 0, high).alias("ci_high"),
    )


def long_report(results: DataFrame) -> DataFrame:
    """All report metrics as (season, baseline, section, label, metric, value)."""
    tallies = materialize(tally(results))
    both = ["season", "baseline"]
    predictions = tallies.groupBy("baseline", "prediction").agg(
        F.sum("n").alias("n"), F.sum(F.col("total_points") * F.col("n")).alias("_actual")
    ).withColumn("season", F.lit(POOLED))

    def rows(df: DataFrame, section: str, label: Column, metrics: list[str]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        spread = df.select(*both, F.lit(section).alias("section"), label.cast("string").alias("label"), F.explode(entries).alias("_m"))
        return spread.select(*both, "section", "label", "_m.metric", "_m.value")

    parts = [
        rows(_summary_of(tallies), "errors", F.lit("all"), ["n", "mae", "rmse", "spearman_mean"]),
        rows(_event_rows(_error_sums(tallies), both), "error_by_event", F.col("bucket"), ["mae", "n"]),
        rows(_calibration_of_counts(predictions, both), "calibration", F.col("bin"), ["mean_prediction", "mean_actual", "n"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report_document(report: DataFrame) -> DataFrame:
    """The long report as one JSON text per (season, model)."""
    entry = F.struct("section", "label", "metric", "value")
    # A report holds a fixed number of metrics per model, so the list is short.
    packed = F.to_json(F.struct("season", "baseline", F.array_sort(F.collect_list(entry)).alias("metrics")))
    return report.groupBy("season", "baseline").agg(packed.alias("document"))
