import numpy as np
import pandas as pd
import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from touchline.operators import metrics, ranks

TYPES = (
    "season string, gw bigint, baseline string, element_id bigint, position string, prediction double, total_points bigint, minutes bigint, "
    "goals_scored bigint, assists bigint, clean_sheets bigint, bonus bigint, bps bigint, error double"
)


def results(spark, rows):
    return spark.createDataFrame(
        [("s", 1, "b", i, pos, float(p), a, m, g, 0, 0, 0, 0, float(p) - a) for i, (pos, p, a, m, g) in enumerate(rows)], TYPES
    )


ROWS = [("FWD", 1, 1, 90, 1), ("FWD", 2, 2, 90, 0), ("FWD", 3, 3, 0, 0), ("MID", 5, 1, 90, 0), ("MID", 5, 9, 90, 0)]


def test_errors_per_position(spark):
    got = as_dict(metrics.error_metrics(results(spark, ROWS), ["position"]), "position", "mae")
    assert got == {"FWD": 0.0, "MID": 4.0}
    assert metrics.error_metrics(results(spark, []), ["position"]).count() == 0


def test_spearman_within_position_ignores_undefined(spark):
    got = as_dict(metrics.spearman_within(results(spark, ROWS), ["baseline"]), "position", "spearman")
    assert got["FWD"] == pytest.approx(1.0) and got["MID"] is None and got["mean"] == pytest.approx(1.0)


def test_ranks_and_spearman_match_pandas_on_ties(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": rng.integers(0, 3, 600), "x": np.round(rng.normal(0, 50, 600), 0), "y": rng.integers(-5, 5, 600)})
    df = spark.createDataFrame(frame)
    got = ranks.average_rank(df, ["k"], "x").toPandas()
    want = frame.groupby("k")["x"].rank()
    assert sorted(got["avg_rank"]) == sorted(want)
    rho = as_dict(metrics.spearman(df, "x", "y", ["k"]), "k", "spearman")
    for k, part in frame.groupby("k"):
        assert rho[k] == pytest.approx(part["x"].rank().corr(part["y"].rank()))
    r = as_dict(metrics.pearson(df, "x", "y", ["k"]), "k", "pearson")
    for k, part in frame.groupby("k"):
        assert r[k] == pytest.approx(part["x"].corr(part["y"]))


def test_pearson_keeps_null_groups_and_large_offsets(spark):
    rows = [(k, 1e9 + x, 2.0 * x) for k in ("a", None) for x in range(5)] + [("flat", 0.1, float(x)) for x in range(3)]
    r = as_dict(metrics.pearson(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]), "k", "pearson")
    assert r["a"] == pytest.approx(1.0) and r[None] == pytest.approx(1.0) and r["flat"] is None


def test_ranks_spread_over_tasks_whatever_the_scale(spark):
    """Values close together far from zero, nulls, infinities and null groups."""
    rng = np.random.default_rng(4)
    base = np.concatenate([1.7e9 + np.round(rng.uniform(0, 1e6, 4000)), [np.inf, -np.inf, -0.0, 1e-300, -1e300]])
    rows = [(k, float(v)) for k in ("a", None) for v in base] + [("a", None), (None, None), ("b", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, v double")
        counts = df.filter("v IS NOT NULL").groupBy("k", "v").count().withColumnRenamed("count", "n")
        running = ranks.cumulative_counts(counts, ["k"], "v")
        stored = spark.read.parquet(*[f for f in running.inputFiles()])
        assert min(r["count"] for r in stored.groupBy("_task").count().collect()) > 100 and stored.select("_task").distinct().count() == 4
        got = ranks.average_rank(df, ["k"], "v").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = pd.Series(base).rank().tolist()
    for part in (got[got["k"] == "a"], got[got["k"].isna()]):
        known = part.dropna(subset=["v"])
        assert len(part) == len(base) + 1 and sorted(known["avg_rank"]) == sorted(want)
        assert (known.sort_values("v")["avg_rank"].diff().dropna() >= 0).all()
    assert len(got) == len(rows) and got[got["v"].isna()]["avg_rank"].isna().all()


def test_null_groups_are_groups_in_spearman_and_calibration(spark):
    rows = [("FWD", p, p * p % 11, 90, 0) for p in range(30)]
    named = results(spark, rows)
    both = named.unionByName(named.withColumn("baseline", F.lit(None).cast("string")))
    rho = as_dict(metrics.spearman(both, "prediction", "total_points", ["baseline"]), "baseline", "spearman")
    assert rho[None] == pytest.approx(rho["b"]) and len(rho) == 2
    bins = metrics.calibration(both, ["baseline"])
    only = lambda where: sorted(tuple(r)[1:] for r in bins.filter(where).collect())
    assert only("baseline IS NULL") == only("baseline = 'b'") and len(only("baseline = 'b'")) == 10
    plan = bins._jdf.queryExecution().optimizedPlan().toString()
    assert all("_task" in line for line in plan.splitlines() if "Join" in line)


def test_bins_are_the_quantiles_bins(spark):
    rng = np.random.default_rng(6)
    for size in (1, 2, 9, 10, 11, 400):
        values = np.round(rng.normal(0, 2, size), 1)
        counts = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double").groupBy("k", "v").count().withColumnRenamed("count", "n")
        got = as_dict(ranks.quantile_bins(counts, ["k"], "v", 10), "v", "bin")
        breaks = np.quantile(values, [i / 10 for i in range(1, 10)])
        assert got == {v: int((breaks < v - 1e-12).sum()) for v in set(values.tolist())}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(3, 2, 501), 1)
    counts = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double").groupBy("k", "v").count().withColumnRenamed("count", "n")
    probabilities = [i / 10 for i in range(1, 10)]
    got = ranks.quantile_breaks(counts, ["k"], "v", probabilities).first()["breaks"]
    assert got == pytest.approx(list(np.quantile(values, probabilities)))


def test_calibration_bins_cover_all_rows(spark):
    rows = [("MID", p % 7, p % 5, 90, 0) for p in range(70)]
    got = metrics.calibration(results(spark, rows), ["baseline"]).collect()
    assert sum(r["n"] for r in got) == 70
    means = [r["mean_prediction"] for r in sorted(got, key=lambda r: r["bin"])]
    assert means == sorted(means)


def test_error_by_event_and_report(spark):
    df = results(spark, ROWS)
    got = {r["bucket"]: (r["mae"], r["n"]) for r in metrics.error_by_event(df, ["baseline"]).collect()}
    assert got["blank_(0_minutes)"] == (0.0, 1) and got["goal_involvement"] == (0.0, 1) and got["bonus_earned"] == (None, 0)
    report = metrics.long_report(df)
    assert report.filter("season = 'pooled' AND metric = 'mae' AND section = 'errors'").first()["value"] == pytest.approx(8 / 5)
    assert metrics.report_document(report).count() == 2


def test_minutes_scorecard_perfect_and_wrong(spark):
    make = lambda p, m: spark.createDataFrame([("k", *p, m)], "k string, p_blank double, p_short double, p_full double, minutes bigint")
    good = metrics.minutes_scorecard(make((0.0, 0.0, 1.0), 90), ["k"]).first()
    bad = metrics.minutes_scorecard(make((1.0, 0.0, 0.0), 90), ["k"]).first()
    assert (good["brier_full"], good["mae_expected_minutes"]) == (0.0, 0.0)
    assert (bad["brier_blank"], bad["brier_full"]) == (1.0, 1.0)
