"""Shared-folder helpers, and workers that give their memory back.

Intermediate tables that must survive the loss of an executor go to the folder
named by ``spark.checkpoint.dir``; a folder of our own is set only where that
setting is absent and Spark runs on one machine.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; creates one only in local mode, and only if none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if configured is None:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="millrace-shared-")
    sc.setCheckpointDir(configured)
    fs, hadoop = _fs(spark, sc._jsc.sc().getCheckpointDir().get())  # a folder of this application alone
    fs.deleteOnExit(hadoop)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan above it reads files every executor can open."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder, in folders by a column if asked, and read it back.

    Meant for wide binary payloads, which a checkpoint would keep uncompressed.
    The folder is removed by ``discard`` or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    fs, hadoop = _fs(spark, path)
    fs.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for tables that nothing will read again."""
    for table in tables:
        fs, hadoop = _fs(table.sparkSession, table._millrace_path)
        fs.delete(hadoop, True)


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def tidy(run):
    """``run`` for mapInArrow, giving freed memory back to the system at the end of each task.

    Python workers are kept for later stages; what they hold on to would count
    against the executor for the rest of the application.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return wrapped
