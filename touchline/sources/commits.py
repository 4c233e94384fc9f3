"""Write-once files: the one step that two writers of a table cannot both take."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any
from urllib.parse import quote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has taken this step."""


def publish_once(spark: SparkSession, uri: str, content: dict[str, Any]) -> bool:
    """Put a small JSON file at `uri`, whole, unless there is one; False if there is.

    The content is written under another name first. A hard link (local and
    network file systems) or a rename that refuses an existing target (HDFS)
    gives it its name, so that readers see all of it or nothing, and of two
    writers one is refused. An object store needs a connector whose rename is
    atomic.
    """
    scratch = f"{uri}.{uuid.uuid4().hex}.tmp"
    text = json.dumps(content, sort_keys=True)
    if urlparse(uri).scheme in ("", "file"):
        path, own = urlparse(uri).path, urlparse(scratch).path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(own, "w") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(own, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    jvm = spark.sparkContext._jvm
    path, own = jvm.org.apache.hadoop.fs.Path(uri), jvm.org.apache.hadoop.fs.Path(scratch)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path.getParent())
    out = store.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(path) or not store.rename(own, path):
        store.delete(own, False)
        return False
    return True


def read_published(spark: SparkSession, folder: str) -> dict[str, dict[str, Any]]:
    """Name without ending -> content of the published files of a folder."""
    try:
        rows = spark.read.text(f"{folder}/*.json", wholetext=True).selectExpr("_metadata.file_name AS name", "value").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {row["name"].removesuffix(".json"): json.loads(row["value"]) for row in rows}


def withdraw(spark: SparkSession, uri: str) -> None:
    """Remove a published file, or a folder of rows that were not published; only its writer may."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def marker(folder: str, name: Any) -> str:
    """The file of a key's value; values that differ have files that differ."""
    return f"{folder}/{quote('null' if name is None else '=' + str(name), safe='=')}.json"


class CommitLog:
    """Numbered commits of a table: each is the table's whole map from part to version.

    Commit n + 1 is published once, so a writer that started from commit n and
    comes second is refused and must start again. Only the newest commit is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path}/_commits"

    def newest(self) -> tuple[int, dict[str, Any]]:
        """(number, content) of the newest commit; (0, {}) without any."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        store = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        numbers = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        if not numbers:
            return 0, {}
        uri = self._uri(numbers[-1])
        (row,) = self.spark.read.text(uri, wholetext=True).collect()
        return numbers[-1], json.loads(row["value"])

    def publish(self, number: int, content: dict[str, Any]) -> None:
        if not publish_once(self.spark, self._uri(number), content):
            raise Conflict(f"commit {number} of {self.folder} is taken")

    def _uri(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"
