"""Shared folder, written tables and small array helpers of the operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..workers import importable

#: Rows of one Arrow batch to a Python worker: long documents must not pile up in one batch.
BATCH_ROWS = 1000


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where it is unset, a local master gets one of its own, and any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="folio-"))
    return base.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        drop(spark, path)


class Scratch:
    """Written tables of one operator call; drop() as soon as a table was consumed, the rest goes when the driver exits."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_drop_quietly, spark, self.path)

    def write(self, df: DataFrame, table: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**({"compression": "zstd"} | options)).parquet(f"{self.path}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{table}")

    def drop(self, table: str) -> None:
        drop(self.spark, f"{self.path}/{table}")

    def keep(self, *tables: str) -> None:
        """Delete all tables of this call but these."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(where):
            if status.getPath().getName() not in tables:
                fs.delete(status.getPath(), True)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Settings of the operators that run Python: small batches, and workers that can import this package. Both stay with the session, as plans run later."""
    importable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What a Python worker holds from one task to the next: a name, and how it is let go.
HELD: dict[str, Callable[[], None]] = {}


def alone(name: str = "") -> None:
    """Begin a task that uses what `name` holds: a reused worker lets all else go, and gives freed memory back to the system."""
    for other, clear in HELD.items():
        if other != name:
            clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def free_name(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
