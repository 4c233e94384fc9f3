from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_snapshots import T0, TYPES, snap

from touchline.operators import snapshots
from touchline.sources.commits import CommitLog, Conflict, publish_once
from touchline.streaming import changes

COLUMNS = ["gw", "element_id", "snapshot_ts", "now_cost", "chance_of_playing_next_round"]


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, TYPES).coalesce(1).write.parquet(f"{folder}/{name}")


def run(query):
    started = query.trigger(availableNow=True).start()
    assert started.awaitTermination(120)


def source(spark, folder):
    schema = spark.createDataFrame([], TYPES).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def rows_of(df, columns=COLUMNS):
    return sorted(map(tuple, df.select(columns).collect()), key=repr)


def test_stream_equals_batch_and_counts_late_rows(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [snap(9), snap(8), snap(9, element=2)]
    second = [snap(7, cost=51), snap(6, cost=51), snap(6, element=2, chance=75)]
    query = lambda: changes.stream_changes(source(spark, landing)).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp"))
    land(spark, landing, "a", first)
    run(query())
    land(spark, landing, "b", second)
    run(query())
    got = spark.read.parquet(out)
    want = snapshots.changed_rows(spark.createDataFrame(first + second, TYPES))
    assert rows_of(got.filter("kind = 'changed'")) == rows_of(want)
    land(spark, landing, "c", [snap(8.5, cost=99), snap(5, cost=52)])
    run(query())
    land(spark, landing, "d", [snap(8.2, cost=99), snap(5, cost=53)])
    run(query())
    got = spark.read.parquet(out)
    # a count so far: the state keeps it over restarts
    assert sorted(r["n_late"] for r in got.filter("kind = 'late'").collect()) == [1, 3]
    assert got.filter("kind = 'changed' AND now_cost IN (99, 53)").count() == 0 and got.filter("now_cost = 52").count() == 1


def test_late_is_judged_by_all_order_columns_with_nulls_first():
    import pandas as pd

    capture = changes.ChangeCapture(["v"], ["ts", "id"], ["k"], ["k", "ts", "id", "v"], None)
    t = pd.Timestamp("2025-01-01")
    rows = pd.DataFrame({"ts": [pd.NaT, t, t, t, t, t + pd.Timedelta(1)], "id": [9, 1, 2, 2, 3, 0], "v": 1})
    assert list(capture._late(rows, None)) == [False, False, False, True, False, False]
    assert list(capture._late(rows, (t.to_pydatetime(), 2, 0))) == [True, True, True, True, False, False]
    assert list(capture._late(rows, (None, 8, 0))) == [False, False, False, True, False, False]


def test_rows_without_a_key_value_take_no_other_keys_with_them(spark, tmp_path):
    """A null key is a key of its own; those next to it in a batch keep their state."""
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [snap(9, element=e) for e in (None, 1, 2, 3)]
    second = [snap(h, element=e, cost=51 + e) if e else snap(h, element=None) for e in (None, 1, 2, 3) for h in (8, 7)]
    for name, rows in (("a", first), ("b", second)):
        land(spark, landing, name, rows)
        run(changes.stream_changes(source(spark, landing)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    got, want = spark.read.parquet(out), snapshots.changed_rows(spark.createDataFrame(first + second, TYPES))
    assert rows_of(got) == rows_of(want) and got.count() == 4 + 3


def test_value_by_value_equals_whole_columns():
    """The rules of `_late` and `differs`, on keys with and without a state, with nulls, NaN and repeated order values."""
    import random

    import pandas as pd
    from pyspark.sql import Row

    class Value:
        def __init__(self, kept=None):
            self.kept = kept

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, kept):
            self.kept = kept

    rng, payload = random.Random(5), ["k", "ts", "id", "v"]
    for _ in range(300):
        last = rng.choice([None, (T0 + timedelta(rng.randrange(4)), rng.choice([None, 1, 2]), rng.choice([None, 1.0, 2.0]))])
        rows = [
            Row(k=7, ts=rng.choice([None, *[T0 + timedelta(d) for d in range(4)]]), id=rng.choice([None, 1, 2]), v=rng.choice([None, float("nan"), 1.0, 2.0]))
            for _ in range(rng.randrange(1, 8))
        ]
        capture = changes.ChangeCapture(["v"], ["ts", "id"], ["k"], payload, None)
        capture.last, capture.n_late = Value(last), Value((4,))
        got = list(capture.handleInputRows((7,), iter(rows), None))
        frame = pd.DataFrame(rows, columns=payload).astype({"ts": "datetime64[us]", "id": "float64", "v": "float64"})
        frame = frame.sort_values(["ts", "id"], kind="stable", na_position="first", ignore_index=True)
        late = capture._late(frame, last)
        fresh = frame[~late].reset_index(drop=True)
        before = pd.concat([pd.DataFrame({"v": [last[2] if last else None]}, dtype=object), fresh[["v"]].iloc[:-1].astype(object)], ignore_index=True)
        kept = changes.differs(fresh[["v"]], before.iloc[: len(fresh)])
        if last is None and len(fresh):
            kept[0] = True
        plain = lambda x: None if pd.isna(x) else x
        want = [(7, *[plain(x) for x in r[1:]]) for r in fresh[kept].itertuples(index=False)]
        assert [(r["k"], r["ts"], r["id"], r["v"]) for r in got if r["kind"] == "changed"] == want
        assert [r["n_late"] for r in got if r["kind"] == "late"] == ([4 + int(late.sum())] if late.any() else [])
        if len(fresh):
            assert tuple(capture.last.kept) == tuple(plain(x) for x in fresh.iloc[-1][["ts", "id", "v"]])


def test_differs_takes_nulls_as_equal():
    import pandas as pd

    a = pd.DataFrame({"x": [1.0, None, None, 2.0], "s": ["a", "a", None, "b"]})
    b = pd.DataFrame({"x": [1.0, None, 3.0, 2.0], "s": ["a", "b", None, "b"]})
    assert list(changes.differs(a, b)) == [False, True, True, False]


def test_latest_state_over_batches(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "latest")
    land(spark, landing, "a", [snap(3, cost=1), snap(3, element=2, cost=5)])
    land(spark, landing, "b", [snap(2, cost=2), snap(4, element=2, cost=6)])
    stream = source(spark, landing)
    run(changes.stream_latest(stream, out, str(tmp_path / "cp"), ["element_id"]))
    got = {r["element_id"]: (r["now_cost"], r["snapshot_ts"]) for r in changes.read_latest(spark, out, stream.schema).collect()}
    assert got == {1: (2, T0 - timedelta(hours=2)), 2: (5, T0 - timedelta(hours=3))}


def test_latest_state_survives_new_checkpoints_replays_and_lost_commits(spark, tmp_path):
    out = str(tmp_path / "latest")
    frame = lambda rows: spark.createDataFrame(rows, TYPES)
    everything = [snap(h, element=e, cost=100 * e + int(10 * h)) for e in range(1, 30) for h in (9, 5, 2)]
    batches = [everything[0::3], everything[1::3], everything[2::3]]
    wanted = rows_of(snapshots.latest_state(frame(everything)))
    for rows in (batches[2], batches[0], batches[1], batches[0]):  # out of order, one of them twice
        changes.upsert_latest(frame(rows), out, ["element_id"], ("snapshot_ts",), buckets=5)
    assert rows_of(changes.read_latest(spark, out, frame([]).schema)) == wanted
    # the same input again through a stream whose checkpoint starts at batch 0
    landing = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        land(spark, landing, f"f{i}", rows)
    for checkpoint in ("cp1", "cp2"):
        run(changes.stream_latest(source(spark, landing), out, str(tmp_path / checkpoint), ["element_id"]))
    assert rows_of(changes.read_latest(spark, out, frame([]).schema)) == wanted
    # a version written without a commit is no part of the table, and goes with the old ones
    frame([snap(0, cost=7)]).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{out}/version=999999999999-lost")
    assert rows_of(changes.read_latest(spark, out, frame([]).schema)) == wanted
    assert "version=999999999999-lost" in changes.drop_old_versions(spark, out)
    assert rows_of(changes.read_latest(spark, out, frame([]).schema)) == wanted


def test_only_touched_buckets_are_written(spark, tmp_path):
    out = str(tmp_path / "latest")
    frame = lambda rows: spark.createDataFrame(rows, TYPES)
    changes.upsert_latest(frame([snap(9, element=e) for e in range(1, 60)]), out, ["element_id"], ("snapshot_ts",), buckets=8)
    _, before = CommitLog(spark, out).newest()
    changes.upsert_latest(frame([snap(1, element=3, cost=9)]), out, ["element_id"], ("snapshot_ts",))
    number, after = CommitLog(spark, out).newest()
    assert number == 2 and after["buckets"] == 8 and sum(after["parts"][b] != v for b, v in before["parts"].items()) == 1
    changes.upsert_latest(frame([]), out, ["element_id"], ("snapshot_ts",))
    assert CommitLog(spark, out).newest()[0] == 2


def test_a_commit_is_taken_once(spark, tmp_path):
    log, other = CommitLog(spark, str(tmp_path)), CommitLog(spark, f"file://{tmp_path}")
    assert log.newest() == (0, {})
    log.publish(1, {"by": "a"})
    with pytest.raises(Conflict):
        other.publish(1, {"by": "b"})
    assert other.newest() == (1, {"by": "a"})
    assert publish_once(spark, f"{tmp_path}/x/y.json", {}) and not publish_once(spark, f"{tmp_path}/x/y.json", {})
