"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut, tidy

EDGES = "a long, b long"
PER_TASK = 1 << 17  # edges that a task takes of a cut: a round over few edges is not dealt to as many tasks and files as a shuffle has


def forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the edges (x, y) that form a spanning forest."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := up.get(i, i)) != i:
            up[i] = up.get(j, j)
            i = j
        return i

    keep = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        i, j = find(a), find(b)
        if i != j:
            up[max(i, j)] = min(i, j)
            keep.append(k)
    return np.array(keep, np.int64)


def _thin(batches):
    """Each batch's spanning forest: edges that say nothing new never reach a shuffle."""
    for batch in batches:
        keep = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield batch.take(pa.array(keep))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable, for every id of ``edges`` (a, b).

    Each step sends every node to the smallest neighbour of a node, so a path of
    n nodes takes O(log n) rounds and hubs only ever hand on one value.  Lineage
    is cut after each round.  A round's edges are in one task for every PER_TASK of
    them, so few edges do not make as many files as a shuffle has partitions.
    """
    now = cut(_flat(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(tidy(_thin), EDGES)))
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = cut(_small_star(_large_star(now, _tasks(state)), _tasks(state)))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return labels.unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component"))).coalesce(_tasks(state)).groupBy("id").agg(F.min("component").alias("component"))


def merged(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of ``known`` once ``edges`` (a, b) are added: only the edges between components are worked on."""
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(known.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    ends = ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    top = cut(components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b")))
    nodes = known.unionByName(ends.select(F.col("a").alias("id"), F.col("ca").alias("component"))).unionByName(ends.select(F.col("b").alias("id"), F.col("cb").alias("component"))).distinct()
    return nodes.join(top.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their 64-bit hashes: equal for equal sets of edges."""
    found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(found)


def _flat(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tasks(state: tuple) -> int:
    return max(1, -(-state[0] // PER_TASK))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (a, b), a < b, from every larger neighbour of a node to the least node around it; some may come twice."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).coalesce(tasks)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    edges = edges.coalesce(tasks)
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    return _flat(edges.join(low, "b").select(F.col("a").alias("b"), F.col("m").alias("a")).unionByName(low.select("b", F.col("m").alias("a"))).coalesce(tasks))
