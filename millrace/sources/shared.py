"""Working folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = files(spark, path)
    return bool(fs.exists(hadoop))


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` (on one machine without that setting, a temporary one), removed when the JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="millrace-work-")
    path = f"{base}/millrace-{name}-{uuid.uuid4().hex}"
    fs, hadoop = files(spark, path)
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path
