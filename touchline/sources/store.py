"""Tables on shared storage: append-only, written once, or replaced."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.sources.commits import marker, publish_once, read_published, withdraw


class AlreadyRecorded(RuntimeError):
    """The key is stored already; stored rows are never replaced."""


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="touchline-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate results, in the shared folder."""
    return f"{shared_folder(spark)}/touchline/{spark.sparkContext.applicationId}"


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by `keys` over all shuffle partitions, which stay apart.

    Adaptive execution joins partitions up by their packed size. Where a task
    sorts, groups or multiplies its rows they take many times that, and the task
    would grow with the table.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and read it back.

    For a result that several parts of a plan read: it is computed once, the
    readers see its true size, and a lost executor does not recompute it. The job
    runs now. `clear_scratch` removes what an application has written so.
    """
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """As `materialize`, dealt into buckets by `keys`, which readers know.

    Windows, groups and joins on these keys, or on more columns with them, need
    no further exchange of the table. `df` is exchanged by the keys here unless it
    is already.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"touchline_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).option("path", f"{scratch_folder(spark)}/{name}").saveAsTable(name)
    stored = spark.table(name)
    # the name is needed to write buckets only; an external table's files stay
    spark.sql(f"DROP TABLE {name}")
    return stored


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM for a collection, so that Spark deletes the shuffle files and broadcasts of plans nobody holds.

    Spark does so when the driver collects by itself. A job of many small steps
    leaves their files on the executors' disks until then, and the driver's heap
    grows to its limit with what the steps left.
    """
    spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate results; DataFrames that read them are of no more use."""
    withdraw(spark, scratch_folder(spark))


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored rows, or a typed empty frame where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_changes(changed: DataFrame, path: str, partition: str = "gw") -> bool:
    """Append changed rows, computed once; nothing is written for an empty input."""
    changed = materialize(changed)
    if changed.isEmpty():
        return False
    changed.write.mode("append").partitionBy(partition).parquet(path)
    return True


CLAIMS, PUBLISHED = "_claims", "_published"


def append_once(df: DataFrame, path: str, key: str = "gw") -> None:
    """Append rows whose key is new, computed once; refuse an empty input or a stored key.

    A key is claimed by a file that can be put in place once, then its rows are
    written, then it is published. Of two writers of one key at the same time one
    is refused before it writes. A writer that fails gives its claims back; one
    that dies leaves a claim without publication (`unfinished`), whose rows
    `load_recorded` leaves out, until `discard` clears it. The keys of one call
    are few: each is a folder.
    """
    df = materialize(df)
    spark = df.sparkSession
    keys = [row[0] for row in df.select(key).distinct().orderBy(key).collect()]
    if not keys:
        raise ValueError("refusing to append an empty table")
    taken = df.select(key).intersect(load_table(spark, path, df.schema).select(key)).limit(5).collect()
    if taken:
        raise AlreadyRecorded(f"{key} {[row[0] for row in taken]} already recorded in {path}")
    owner, claimed = uuid.uuid4().hex, []
    try:
        for value in keys:
            if not publish_once(spark, marker(f"{path}/{CLAIMS}", value), {"key": str(value), "owner": owner}):
                raise AlreadyRecorded(f"{key} {value!r} of {path} is claimed by another writer")
            claimed.append(value)
        df.write.mode("append").partitionBy(key).parquet(path)
    except Exception:
        for value in claimed:
            withdraw(spark, marker(f"{path}/{CLAIMS}", value))
        raise
    for value in keys:
        publish_once(spark, marker(f"{path}/{PUBLISHED}", value), {"key": None if value is None else str(value)})


def load_recorded(spark: SparkSession, path: str, schema: T.StructType, key: str = "gw") -> DataFrame:
    """The rows of published keys; other folders are not read."""
    names = [content["key"] for content in read_published(spark, f"{path}/{PUBLISHED}").values()]
    rows, kind = load_table(spark, path, schema), schema[key].dataType
    known = F.col(key).isin([F.lit(n).cast(kind) for n in names if n is not None]) if any(n is not None for n in names) else F.lit(False)
    return rows.filter(known | (F.col(key).isNull() if None in names else F.lit(False)))


def unfinished(spark: SparkSession, path: str) -> list[str]:
    """Keys that were claimed and not published: being written, or left by a writer that died."""
    return sorted(set(read_published(spark, f"{path}/{CLAIMS}")) - set(read_published(spark, f"{path}/{PUBLISHED}")))


def discard(spark: SparkSession, path: str, value, key: str = "gw") -> None:
    """Clear a key whose writer died: its rows, then its claim. A published key is refused."""
    name = marker("", value).strip("/").removesuffix(".json")
    if name in read_published(spark, f"{path}/{PUBLISHED}"):
        raise AlreadyRecorded(f"{key} {value!r} of {path} is published")
    folder = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
    withdraw(spark, f"{path}/{key}={folder}")
    withdraw(spark, marker(f"{path}/{CLAIMS}", value))


def write_season(df: DataFrame, path: str, partition: str = "season") -> None:
    """Replace the seasons in `df`, and only those."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_reference(dims: dict[str, DataFrame], path: str) -> None:
    """Replace the small reference tables."""
    for name, df in dims.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def latest_period(frozen: DataFrame, key: str = "gw") -> DataFrame:
    """The highest stored period; null when nothing is stored."""
    return frozen.agg(F.max(key).alias(f"latest_{key}"))
