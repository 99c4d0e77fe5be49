"""Counts by hash bucket over a whole corpus: fixed size, summed over a tree of tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import tidy

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
CHUNK = 1 << 16
FAN_IN = 32


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def chunk_rows(counts: np.ndarray, chunk: int = CHUNK):
    """(chunk, bytes) of the chunks that hold anything."""
    for c in range(0, len(counts), chunk):
        part = counts[c : c + chunk]
        if part.any():
            yield c // chunk, part.tobytes()


def batch_of(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])


def _adder(dtype: str):
    """Sum of the rows of each chunk in a task that has them in order; one chunk is held at a time."""

    def run(batches):
        now, total = None, None
        for batch in batches:
            for c, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(data, dtype)
                if c != now:
                    if now is not None:
                        yield batch_of([(now, total.tobytes())])
                    now, total = c, part.astype(np.int64)
                else:
                    total += part
        if now is not None:
            yield batch_of([(now, total.tobytes())])

    return tidy(run)


def summed(chunks: DataFrame, dtype: str) -> DataFrame:
    """(chunk, counts): exact sums of all (chunk, counts) rows of integers, in two levels, as int64.

    Every task of the corpus sends a row a chunk.  They are summed in as many
    groups as there are tasks over FAN_IN first, so no task of the last level
    reads more than that many rows of one chunk.
    """
    wide = chunks.select("chunk", "counts")
    groups = max(1, -(-wide.rdd.getNumPartitions() // FAN_IN))
    if groups > 1:
        dealt = wide.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition("chunk", "part")
        first = dealt.sortWithinPartitions("part", "chunk").select("chunk", "counts").mapInArrow(_adder(dtype), "chunk int, counts binary")
        wide, dtype = first, "int64"
    return wide.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_adder(dtype), "chunk int, counts binary")


def add_up(chunks: DataFrame, dtype: str, size: int, chunk: int = CHUNK) -> np.ndarray:
    """The sums of summed() in one array."""
    out = np.zeros(size, np.int64)
    for r in summed(chunks, dtype).collect():  # ``size`` numbers in all
        part = np.frombuffer(bytes(r["counts"]), np.int64)
        out[r["chunk"] * chunk : r["chunk"] * chunk + len(part)] = part
    return out
