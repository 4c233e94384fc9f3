"""Change capture and latest state over an unbounded snapshot stream.

Policy for late rows: a row that is not newer than what its key has already
taken in is dropped, and counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from touchline.operators.snapshots import TRACKED_COLUMNS, latest_state
from touchline.sources.commits import CommitLog

CHANGED, LATE = "changed", "late"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Typed state lives in the store on disk, so keys need not fit into memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def differs(values: pd.DataFrame, before: pd.DataFrame) -> np.ndarray:
    """True where a row's values differ from those on the same place of `before`; null equals null."""
    out = np.zeros(len(values), bool)
    for c in values.columns:
        new, old = values[c], before[c]
        gone, was_gone = new.isna().to_numpy(), old.isna().to_numpy()
        unlike = (new.to_numpy(object) != old.to_numpy(object)) & ~gone & ~was_gone
        out |= unlike | (gone != was_gone)
    return out


class ChangeCapture(StatefulProcessor):
    """Per key: its last order values and tracked values, and the number of late rows so far."""

    def __init__(self, columns: list[str], order: list[str], keys: list[str], payload: list[str], state: T.StructType):
        self.columns, self.order, self.keys, self.payload, self.state_schema = columns, order, keys, payload, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state_schema)
        self.n_late = handle.getValueState("late", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """The rules of `_late` and `differs`, value by value: most keys have one or two rows in a batch."""
        last = self.last.get() if self.last.exists() else None
        newest, before = None, None
        if last is not None:
            newest, before = _placed(last[: len(self.order)]), [_plain(v) for v in last[len(self.order) :]]
        placed = sorted(((_placed(row[c] for c in self.order), row) for row in rows), key=lambda p: p[0])
        n = 0
        for place, row in placed:
            if newest is not None and place <= newest:
                n += 1
                continue
            values = [_plain(row[c]) for c in self.columns]
            if newest is None or values != before:
                yield self._row({c: _plain(row[c]) for c in self.payload}, CHANGED, None)
            newest, before = place, values
        if n < len(placed):
            self.last.update((*[v for _, v in newest], *before))
        if n:
            total = n + (self.n_late.get()[0] if self.n_late.exists() else 0)
            self.n_late.update((total,))
            yield self._row(dict(zip(self.keys, key, strict=True)), LATE, total)

    def _row(self, known: dict, kind: str, n_late: int | None) -> Row:
        return Row(**{c: known.get(c) for c in self.payload}, kind=kind, n_late=n_late)

    def _late(self, rows: pd.DataFrame, last) -> np.ndarray:
        """Rows at or before the state, and rows that repeat an order value of this batch (the first of them counts)."""
        late = rows.duplicated(self.order).to_numpy()
        if last is None:
            return late
        undecided, older = np.ones(len(rows), bool), np.zeros(len(rows), bool)
        for c, at in zip(self.order, list(last)[: len(self.order)], strict=True):
            missing = rows[c].isna().to_numpy()
            if at is None:
                less, same = np.zeros(len(rows), bool), missing
            else:
                at = pd.Timestamp(at) if isinstance(rows[c].dtype, np.dtype) and rows[c].dtype.kind == "M" else at
                less, same = (rows[c] < at).to_numpy(bool) | missing, (rows[c] == at).to_numpy(bool)
            older |= undecided & less
            undecided &= same
        return late | older | undecided

    def close(self) -> None:
        pass


def _plain(value):
    """A value, with NaN as null."""
    return None if value != value else value


def _placed(values: Iterable) -> tuple:
    """Order values so that they compare, nulls first."""
    return tuple((v is not None, v) for v in map(_plain, values))


def change_schema(rows: DataFrame, columns: list[str], keys: tuple[str, ...], order: tuple[str, ...]) -> T.StructType:
    """Columns of `stream_changes`: keys, order, tracked columns, kind, n_late."""
    fields = [T.StructField(c, rows.schema[c].dataType, True) for c in dict.fromkeys([*keys, *order, *columns])]
    return T.StructType([*fields, T.StructField("kind", T.StringType()), T.StructField("n_late", T.LongType())])


def stream_changes(
    stream: DataFrame,
    columns: list[str] = TRACKED_COLUMNS,
    keys: tuple[str, ...] = ("gw", "element_id"),
    order: tuple[str, ...] = ("snapshot_ts",),
) -> DataFrame:
    """Changed rows of the stream as `kind = changed`; where a key had late rows in
    a batch, one row `kind = late` with the number it has had so far in `n_late`.

    A key's rows of one micro-batch are put in order of `order`, nulls first, and
    compared with the row before them; the first one is compared with the key's state. Rows equal in `order` are one row, the others late. The
    state is a typed value a key, kept in the state store on disk. Rows of one key
    and micro-batch meet in memory, in `keys`, `order` and `columns` only: the
    source's rate options (maxFilesPerTrigger and the like) bound them.
    """
    k, o = list(keys), list(order)
    payload = list(dict.fromkeys([*k, *o, *columns]))
    # An instant is a number in here: rows and state would give it with and without a zone.
    instants = [c for c in payload if stream.schema[c].dataType == T.TimestampType()]
    source = stream.select(*payload).withColumns({c: F.unix_micros(c) for c in instants})
    use_state_store(stream.sparkSession)
    out_schema = change_schema(source, columns, keys, order)
    state = T.StructType(
        [T.StructField(f"order_{i}", source.schema[c].dataType) for i, c in enumerate(o)]
        + [T.StructField(f"value_{i}", source.schema[c].dataType) for i, c in enumerate(columns)]
    )
    capture = ChangeCapture(list(columns), o, k, payload, state)
    changed = source.groupBy(*k).transformWithState(capture, out_schema, "Append", "None")
    return changed.withColumns({c: F.timestamp_micros(c) for c in instants})


BUCKETS = 64


def upsert_latest(batch: DataFrame, path: str, keys: list[str], order: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """Merge a batch into the table of latest rows at `path`.

    Keys are dealt to buckets by hash. Only buckets that the batch touches are
    read and written again, each as a new version; one commit then moves all of
    them at once. The merge keeps the largest `order` a key, so it does not matter
    whether a batch comes once, twice or after a later one, nor what number the
    stream gives it: a replayed batch and a stream restarted with a new checkpoint
    leave the right state. `order` must tell the rows of a key apart.
    """
    spark, log = batch.sparkSession, CommitLog(batch.sparkSession, path)
    number, versions = log.newest()
    buckets = versions.get("buckets", buckets)
    schema = batch.schema
    dealt = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in dealt.select("_bucket").distinct().collect())
    if not touched:
        return
    have = {b: v for b, v in versions.get("parts", {}).items() if int(b) in touched}
    before = read_parts(spark, path, have, schema).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    merged = latest_state(before.unionByName(dealt), ["_bucket", *keys], order)
    version = f"{number + 1:012d}-{uuid.uuid4().hex[:8]}"
    merged.write.partitionBy("_bucket").parquet(f"{path}/version={version}")
    parts = {**versions.get("parts", {}), **{str(b): version for b in touched}}
    log.publish(number + 1, {"buckets": buckets, "parts": parts})


def read_parts(spark: SparkSession, path: str, parts: dict[str, str], schema: T.StructType) -> DataFrame:
    """The buckets' rows in the versions given."""
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/version={v}/_bucket={b}" for b, v in sorted(parts.items())])


def stream_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: tuple[str, ...] = ("snapshot_ts",), buckets: int = BUCKETS):
    """A query that keeps the latest row per key at `path`, see `upsert_latest`."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(batch, path, keys, order, buckets)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The latest rows as of the newest commit; only the versions it names are read."""
    _, content = CommitLog(spark, path).newest()
    return read_parts(spark, path, content.get("parts", {}), schema)


def drop_old_versions(spark: SparkSession, path: str) -> list[str]:
    """Delete versions that the newest commit names for no bucket; run it when no reader holds an older commit."""
    _, content = CommitLog(spark, path).newest()
    live = {f"version={v}" for v in content.get("parts", {}).values()}
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dead = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("version=") and s.getPath().getName() not in live]
    for old in dead:
        store.delete(old, True)
    return sorted(p.getName() for p in dead)
