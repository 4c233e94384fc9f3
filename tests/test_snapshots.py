from datetime import datetime, timedelta

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from touchline.functions import market
from touchline.operators import segments, snapshots
from touchline.plans.prices import price_model

T0 = datetime(2025, 9, 10, 12)
TYPES = (
    "gw bigint, element_id bigint, snapshot_ts timestamp, now_cost bigint, selected_by_percent double, transfers_in_event bigint, "
    "transfers_out_event bigint, form double, status string, chance_of_playing_next_round bigint, news_added timestamp, ep_next double"
)


def snap(hours, element=1, gw=1, cost=50, own=10.0, bought=100, sold=50, chance=None):
    return (gw, element, T0 - timedelta(hours=hours), cost, own, bought, sold, 1.0, "a", chance, None, 2.0)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), TYPES)


def test_as_of_picks_the_latest_row_in_any_partition(spark):
    df = frame(spark, snap(2, cost=50), snap(1, cost=51, gw=2), snap(0, cost=52, gw=2))
    cost = lambda h: snapshots.state_as_of(df, T0 - timedelta(hours=h)).collect()
    assert [r["now_cost"] for r in cost(1)] == [51] and [r["now_cost"] for r in cost(0)] == [52] and cost(3) == []
    assert snapshots.latest_state(df, ["gw", "element_id"]).count() == 2


def test_deltas_reuse_older_rows_and_are_null_without_a_baseline(spark):
    df = frame(spark, snap(30, cost=50, own=10.0), snap(0, cost=53, own=25.0), snap(0.5, element=2))
    got = {r["element_id"]: r for r in snapshots.compute_deltas(df, T0, snapshots.reference_times(T0)).collect()}
    assert (got[1]["now_cost_delta_24h"], got[1]["selected_by_percent_delta_24h"], got[1]["now_cost_delta_1h"]) == (3, 15.0, 3)
    assert got[1]["now_cost_delta_72h"] is None and got[2]["now_cost_delta_1h"] is None
    assert "now_cost_delta_since_gw" in snapshots.compute_deltas(df, T0, snapshots.reference_times(T0, T0)).columns


@pytest.mark.parametrize("segment", ["hour", "day", "year"])
def test_only_changes_are_kept_whatever_the_segment(spark, segment):
    rows = [snap(h) for h in range(20, 5, -1)] + [snap(5, cost=51), snap(4, cost=51), snap(3, cost=51, chance=75), snap(2, gw=2, cost=51, chance=75)]
    got = snapshots.changed_rows(frame(spark, *rows), segment=segment).collect()
    assert sorted((T0 - r["snapshot_ts"]).seconds // 3600 for r in got) == [2, 3, 5, 20]


def test_rows_with_a_null_key_are_a_series_of_their_own(spark):
    rows = [snap(h, gw=None) for h in (9, 6, 3)] + [snap(h) for h in (8, 5)] + [snap(2, gw=None, cost=51)]
    got = snapshots.changed_rows(frame(spark, *rows)).collect()
    assert sorted(((T0 - r["snapshot_ts"]).seconds // 3600, r["gw"]) for r in got) == [(2, None), (8, 1), (9, None)]
    left = spark.createDataFrame([(None, T0), (1, T0)], "k bigint, at timestamp")
    right = spark.createDataFrame([(None, T0 - timedelta(days=5), "a")], "k bigint, ts timestamp, v string")
    joined = segments.as_of_join(left, right, ["k"], "at", "ts", ["v"]).collect()
    assert {r["k"]: r["matched"] and r["matched"]["v"] for r in joined} == {None: "a", 1: None}


def test_compare_state_keeps_new_and_changed(spark):
    old, new = frame(spark, snap(1), snap(1, element=2)), frame(spark, snap(0), snap(0, element=2, cost=9), snap(0, element=3))
    assert sorted(r["element_id"] for r in snapshots.compare_state(new, old).collect()) == [2, 3]


def test_as_of_join_carries_over_empty_segments(spark):
    left = spark.createDataFrame([(1, T0), (1, T0 - timedelta(days=9)), (2, T0)], "k bigint, at timestamp")
    right = spark.createDataFrame([(1, T0 - timedelta(days=5), "a"), (1, T0, "b"), (1, T0 + timedelta(hours=1), "c")], "k bigint, ts timestamp, v string")
    for segment in ("hour", "month"):
        got = segments.as_of_join(left, right, ["k"], "at", "ts", ["v"], segment=segment).collect()
        assert {(r["k"], r["at"]): r["matched"] and r["matched"]["v"] for r in got} == {
            (1, T0): "b", (1, T0 - timedelta(days=9)): None, (2, T0): None}


def test_hot_key_gives_the_same_as_a_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.lit(T0).cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 37 % 3000).cast("int"))).alias("ts"), "id",
    )
    got = as_dict(segments.with_previous(df, ["k"], ["ts", "id"], ["id"]).select("id", F.col("_previous.id").alias("p")), "id", "p")
    want = as_dict(df.select("id", F.lag("id").over(Window.partitionBy("k").orderBy("ts", "id")).alias("p")), "id", "p")
    assert got == want


def test_market_signals(spark):
    deltas = spark.createDataFrame(
        [(1, 9.0, 2.0, 2.4, 500, 200)],
        "element_id bigint, selected_by_percent double, selected_by_percent_delta_1h double, selected_by_percent_delta_24h double, "
        "transfers_in_event_delta_1h bigint, transfers_out_event_delta_1h bigint",
    )
    assert market.ownership_acceleration(deltas).first()["ownership_acceleration"] == pytest.approx(1.9)
    assert market.transfer_velocity(deltas, hours=2).first()["transfer_velocity"] == 150.0
    assert market.price_pressure(deltas).first()["price_change_pressure"] == 30.0
    with pytest.raises(ValueError, match="missing"):
        market.transfer_velocity(deltas, "72h")


def test_direction_thresholds(spark):
    got = spark.createDataFrame([(2.0,), (-2.0,), (0.1,), (None,)], "p double").select(market.predict_direction(F.col("p"))).collect()
    assert [r[0] for r in got] == ["rise", "fall", "stable", "stable"]


def test_price_model_hit_rate_and_no_moves(spark):
    before = T0 - timedelta(hours=24)
    rows = [snap(30, e, bought=0, sold=0) for e in (1, 2, 3)]
    rows += [snap(24, 1, bought=90, sold=0), snap(24, 2, bought=90, sold=0), snap(0, 1, cost=51), snap(0, 2, cost=49)]
    got = price_model(frame(spark, *rows), before, T0).first()
    assert (got["n"], got["n_moves_predicted"], got["hit_rate"]) == (3, 2, 0.5) and got["ci_low"] == 0.0 and got["ci_high"] == 1.0
    idle = price_model(frame(spark, *rows[:3]), before, T0).first()
    assert idle["n_moves_predicted"] == 0 and idle["hit_rate"] is None and idle["ci_low"] is None
    with pytest.raises(ValueError, match="unknown window"):
        price_model(frame(spark, *rows), before, T0, "2h")


def test_retention_keeps_the_cutoff_and_unknown_times(spark):
    df = spark.createDataFrame([(T0 - timedelta(days=7),), (T0 - timedelta(days=8),), (None,)], "ts timestamp")
    assert snapshots.retention_filter(df, "ts", 7, T0).count() == 2
