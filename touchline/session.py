"""Session defaults for local runs, and the package's way to the workers."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import SparkSession

from touchline.sources.store import shared_folder


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster use the session the cluster gives you."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("touchline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


#: Bytes of a method above which the JVM's own compiler leaves it to the interpreter.
HUGE_METHOD = "8000"


def tune(spark: SparkSession) -> None:
    """Settings that plans over wide rows need; a session may be tuned at any time, and settings made by others stay.

    A stage of many columns is generated as one method. Above 8,000 bytes the JVM
    never compiles it, and it runs several times slower than the same operators
    with their expressions in methods of their own, which is what Spark does
    beyond this limit. Spark's default is the largest method there can be.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD)


#: Rows of whole texts that are in a worker, and in the buffers on the way to it, at a time.
BATCH_ROWS = 2000


def bound_memory(spark: SparkSession) -> None:
    """Settings left at their defaults that would take memory beside the heap.

    Ten thousand documents in one Arrow batch are tens of megabytes, several
    times over: in the executor's buffers, which are kept, and in each worker. The
    driver keeps the texts of up to a thousand plans, and iterative jobs have many
    and long ones.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b") == str((1 << 31) - 16):
        spark.conf.set("spark.sql.maxPlanStringLength", "20000")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python workers import the functions that a plan names; they need not be
    installed there, nor need the driver run in the package's folder.
    """
    context = spark.sparkContext
    if getattr(context, "_touchline_shipped", False):
        return
    bound_memory(spark)
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    uri = f"{shared_folder(spark)}/touchline/package-{uuid.uuid4().hex}.zip"
    write_shared(uri, packed.getvalue())
    context.addPyFile(uri)
    context._touchline_shipped = True


def write_shared(uri: str, content: bytes) -> None:
    """One small file into the shared folder, whatever store that is."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(content)
