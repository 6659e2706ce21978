"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows, and about the bytes, that a Python worker gets together while a table is written: whole texts of a batch are in memory at once.
BATCH_ROWS = 1_000
BATCH_BYTES = 4_000_000


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; its own temporary folder only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("tidewell.workspace", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("tidewell.workspace", folder)
    return folder.rstrip("/")


def release_memory() -> None:
    """At the end of a task: hand what Arrow and the C library hold back to the system, as the worker lives on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from files, not from lineage.

    Nothing reads the shuffle files of that write again, so Spark is told to
    remove them at its end instead of at some later garbage collection.  Batches
    for Python workers hold BATCH_ROWS rows or some BATCH_BYTES meanwhile.
    ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    wanted = {_CLEANUP: "true", _ARROW_ROWS: str(BATCH_ROWS), _ARROW_BYTES: str(BATCH_BYTES)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
