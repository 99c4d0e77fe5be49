"""Sharding by extendible hashing (DataFrame functions only).

A directory maps hash prefixes to shards.  The one shard of depth 0 is split on
the next bit while it holds more than ``limit`` bytes, and only oversized
buckets are ever split.  Sizes by prefix come from a histogram of the next 12
bits; rows are looked at again only where a 12-bit cell is itself oversized.

Edge cases: a null text has 0 bytes; rows with a null id are hashed by their
text; rows of equal id share a hash, so a single id larger than the limit stays
one shard of full depth, flagged ``oversize`` (ties); a very long text counts its
bytes like any other; an empty table gives an empty result.  Columns of the input
are never changed: where it has a column of an added name, underscores are put
before the added one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut
from .mixing import BITS, BROADCAST_ROWS, LEVEL_BITS, free_names, id_hash


def _directory(cells: DataFrame, base: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes, shard_docs) of 12-bit cells below depth ``base``; shard_bytes > limit: still too large."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(LEVEL_BITS)))
    nodes = cells.select("cell", "bytes", "docs", steps.alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {LEVEL_BITS} - d)"))
    nodes = nodes.groupBy("d", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    # a shard: fits, or cannot be told apart any further here, under a parent that is too large
    parent = nodes.where(F.col("bytes") > limit).select((F.col("d") + 1).alias("d"), F.col("prefix").alias("up"))
    leaf = nodes.where((F.col("bytes") <= limit) | (F.col("d") == LEVEL_BITS)).withColumn("up", F.shiftright("prefix", 1))
    split = leaf.where(F.col("d") > 0).join(parent, ["d", "up"], "left_semi")
    root = leaf.where((F.col("d") == 0))
    if base:  # what stands below an oversized cell has been split at least once
        root = root.where(F.lit(False))
    leaves = split.unionByName(root).select("d", "prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    of_cell = cells.select("cell", steps.alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {LEVEL_BITS} - d)"))
    return of_cell.join(leaves, ["d", "prefix"]).select("cell", (F.col("d") + base).alias("depth"), "prefix", "shard_bytes", "shard_docs")


SHARDED = ["shard_bytes_own", "shard_depth", "shard_prefix", "shard_bytes", "shard_docs", "oversize"]


def shard(docs: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """Rows and columns of ``docs``, and the columns SHARDED under free names."""
    names = free_names(docs.columns, SHARDED)
    own = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), own.alias("bytes"), id_hash(F.col("doc_id"), F.col("text")).alias("h"))
    rows = cut(out.select("h", "bytes"))
    found = []
    for base in range(0, BITS, LEVEL_BITS):
        shift = BITS - base - LEVEL_BITS
        cells = rows.groupBy(F.shiftright("h", shift).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        level = cut(_directory(cells, base, limit))
        found.append((shift, level))
        large = level.where((F.col("shard_bytes") > limit) & (F.col("depth") == base + LEVEL_BITS)).select(F.col("cell").alias("parent")).distinct()
        if shift == 0 or large.isEmpty():
            break
        rows = rows.join(large, F.shiftright("h", shift) == F.col("parent"), "left_semi")
    for k, (shift, level) in enumerate(found):
        # the directory: one row a cell, sent to all tasks only after counting them
        level = level.select(F.col("cell").alias(f"cell{k}"), F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias(f"found{k}"))
        level = F.broadcast(level) if level.count() <= BROADCAST_ROWS else level
        out = out.join(level, F.shiftright("h", shift) == F.col(f"cell{k}"), "left")
    out = out.withColumn("place", F.coalesce(*[F.col(f"found{k}") for k in reversed(range(len(found)))]))
    made = [F.col("bytes"), F.col("place.depth"), F.col("place.prefix"), F.col("place.shard_bytes"), F.col("place.shard_docs"), F.col("place.shard_bytes") > limit]
    return out.select("row.*", *[value.alias(names[name]) for name, value in zip(SHARDED, made, strict=True)])


def write_shards(sharded: DataFrame, columns: list[str], path: str, depth: str = "shard_depth", prefix: str = "shard_prefix") -> None:
    """One folder a shard; rows of a shard meet in one task, and shards are at most ``limit`` bytes.

    Rows are dealt by a hash of their shard, so texts move once, here.  ``depth`` and
    ``prefix`` name the columns where ``shard`` had to choose others.
    """
    keyed = sharded.select(*columns, F.concat_ws("-", F.lpad(F.col(depth).cast("string"), 2, "0"), F.conv(prefix, 10, 16)).alias("shard"))
    keyed.repartition("shard").write.partitionBy("shard").parquet(path)
