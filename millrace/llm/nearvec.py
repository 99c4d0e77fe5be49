"""Near-duplicate embeddings by counting collisions on sorted one-dimensional projections.

Vectors of one label meet in cells.  Within a cell every vector is projected on
``PROJECTIONS`` fixed directions; a pair is counted once for each projection on
which one lies in the window of half-width ``w`` around the other.  Pairs with at
least ``need`` counts are verified by their cosine in double precision.

Cells come from sorted projections too: a vector's cell is the tuple of the sides
of K further projections on which it lies, in independent repetitions.  Everything
of up to ``TASK`` vectors of a label is done inside one task, so repetitions
cost no shuffle; K follows from what cells and pairs cost.  A large cell is sorted
by its first projection and worked off in blocks of bounded size.  Neither pairs nor
links are kept: a block adds to the numbers of links and to the components of the
vectors, so a dense cluster costs time and no memory.

A label of more than ``TASK`` vectors is dealt to tasks by K0 sides in R0
repetitions first; what is still larger than TASK (a dense cluster) is worked off
in pairs of parts.

One rule holds for labels of every size: a pair exactly at the threshold both meets
in a cell and passes the count with probability ``RECALL`` at least.  What the count
may miss is taken off first, then the cells inside a task; the repetitions are as
many as the rest asks for.

Equal vectors of one label are one class: they are compared once and counted as
often as they occur.  Pairs stay inside a task, which hands on each class's
number of links and a spanning forest of its links, never all pairs.

Edge cases: vectors that are null, zero, or hold null or non-finite components,
and rows without id or label, link with nothing; vectors of different length
never link; very small and very large components are scaled before anything is
squared; repeated rows of one id are separate vectors; ties (a cosine equal to
the threshold) link; an empty table gives no row.  Columns other than vec_id,
embedding and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, forest
from ._session import cut, stored, tidy

PROJECTIONS, TASK, RECALL, MAX_BITS = 24, 1 << 15, 0.9998, 30
BROADCAST_ROWS = 100_000
PAIRS, BLOCK, EDGE = 1 << 18, 256, 1e-12
VECTOR_COST, PAIR_COST = 0.5, 0.2  # microseconds a vector and repetition, and a pair of a cell


@lru_cache(maxsize=64)
def directions(dim: int, count: int, seed: int) -> np.ndarray:
    d = np.random.default_rng([seed, dim]).standard_normal((count, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _below(count: int) -> float:
    """Probability that a pair at the threshold meets in fewer than ``count`` windows."""
    p = math.erf(2.0 / math.sqrt(2))
    return sum(math.comb(PROJECTIONS, c) * p**c * (1 - p) ** (PROJECTIONS - c) for c in range(count))


def window(dim: int, threshold: float) -> tuple[float, int]:
    """Half-width of a window, and the largest number of collisions to ask for that costs no more than a third of what may be missed."""
    need = max(c for c in range(PROJECTIONS + 1) if _below(c) <= (1 - RECALL) / 3)
    return 2.0 * math.sqrt(max(0.0, 2 - 2 * threshold) / dim), need


def repetitions(bits: int, threshold: float) -> int:
    """Repetitions of cells of ``bits`` sides in which a pair at the threshold meets but for a third of what may be missed."""
    if not bits:
        return 1
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log((1 - RECALL) / 3) / math.log(1 - meet))


def cells(n: int, threshold: float) -> tuple[int, int]:
    """(sides of a cell, repetitions) at the least cost for n vectors."""
    cost = {b: repetitions(b, threshold) * ((b > 0) * VECTOR_COST * n + PAIR_COST * n * n / 2 ** (b + 1)) for b in range(MAX_BITS)}
    bits = min(cost, key=cost.get)
    return bits, repetitions(bits, threshold)


def outer(n: int, threshold: float, task: int = TASK) -> tuple[int, int]:
    """(sides, repetitions) by which a label of n vectors is dealt to tasks of about ``task``."""
    bits = max(0, math.ceil(math.log2(max(1, n) / task)))
    return bits, repetitions(bits, threshold)


def sides(v: np.ndarray, bits: int, seed: int) -> np.ndarray:
    return (v @ directions(v.shape[1], bits, seed).T >= 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(v), np.int64)


def _counted(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, width: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (x, y), those that meet in ``need`` windows; a pair is dropped once it cannot reach that."""
    missed = np.zeros(len(x), np.int8)
    for j in range(PROJECTIONS):
        missed += np.abs(px[x, j] - py[y, j]) > width
        if j >= PROJECTIONS - need and j % 4 == 3 or j == PROJECTIONS - 1:
            keep = missed <= PROJECTIONS - need
            x, y, missed = x[keep], y[keep], missed[keep]
    return x, y


def _blocks(pu: np.ndarray, pv: np.ndarray, u: np.ndarray, v: np.ndarray, width: float, need: int, threshold: float, same: bool):
    """Links (x, y) between two sets (of one set, x < y), block by block: both are sorted by the first projection, windows are counted on all of them, and what passes is verified."""
    left = np.argsort(pu[:, 0], kind="stable")
    right = left if same else np.argsort(pv[:, 0], kind="stable")
    # no projection of two vectors is further apart than the vectors are: this window leaves out no link
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-5) + 1e-6
    for at in range(0, len(left), BLOCK):
        rows = left[at : at + BLOCK]
        low = int(np.searchsorted(pv[right, 0], pu[rows[0], 0] - reach, "left"))
        high = int(np.searchsorted(pv[right, 0], pu[rows[-1], 0] + reach, "right"))
        for c in range(max(low, at) if same else low, high, PAIRS // BLOCK):
            columns = right[c : min(high, c + PAIRS // BLOCK)]
            met = np.zeros((len(rows), len(columns)), np.int8)
            for j in range(PROJECTIONS):
                met += np.abs(pu[rows, j][:, None] - pv[columns, j]) <= width
            cosine = u[rows] @ v[columns].T
            x, y = np.nonzero((met >= need) & (cosine >= threshold - EDGE))
            if same and c < at + BLOCK:  # a pair of the block's own rows is met from both sides
                once = x + at < y + c
                x, y = x[once], y[once]
            sure = cosine[x, y] >= threshold + EDGE
            x, y = rows[x], columns[y]
            if same:
                x, y = np.minimum(x, y), np.maximum(x, y)
            near = np.flatnonzero(~sure)  # what the order of a sum might decide is summed as all other pairs are
            sure[near] = np.einsum("ij,ij->i", u[x[near]], v[y[near]]) >= threshold
            yield x[sure], y[sure]


def _pairs(cu: np.ndarray, cv: np.ndarray) -> int:
    """Pairs that meet in the cells."""
    a, m = np.unique(cu, return_counts=True)
    b, n = np.unique(cv, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int((m[i] * n[j]).sum())


def links(u: np.ndarray, v: np.ndarray | None, threshold: float):
    """The distinct pairs (x, y) of unit vectors that link, some at a time; within u if v is None (x < y).

    Pairs of small cells are counted and verified together, large cells block by block.
    A pair that shares a cell of an earlier repetition has had its turn there, so no
    list of pairs is kept: memory does not grow with the number of links.
    """
    n, dim = len(u), u.shape[1]
    right = u if v is None else v
    width, need = window(dim, threshold)
    bits, reps = cells(n if v is None else int(math.sqrt(n * len(v))), threshold)
    d = directions(dim, PROJECTIONS, 1)
    pu = (u @ d.T).astype(np.float32)
    pv = pu if v is None else (v @ d.T).astype(np.float32)
    slack = np.float32(width * (1 + 1e-5) + 1e-6)  # what rounding of projections may take
    codes = [(sides(u, bits, 100 + r), None if v is None else sides(v, bits, 100 + r)) for r in range(reps)]
    codes = [(cu, cu if cv is None else cv) for cu, cv in codes]
    if bits and sum(_pairs(cu, cv) for cu, cv in codes) > n * len(pv):
        codes = [(np.zeros(n, np.int64), np.zeros(len(right), np.int64))]  # dense: one cell costs less than all its repetitions

    def fresh(x: np.ndarray, y: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        keep = x < y if v is None else np.ones(len(x), bool)
        for cu, cv in codes[:r]:
            keep &= cu[x] != cv[y]
        return x[keep], y[keep]

    for r, (cu, cv) in enumerate(codes):
        ou, ov = np.argsort(cu, kind="stable"), np.argsort(cv, kind="stable")
        su, sv = cu[ou], cv[ov]
        cell = np.unique(su)
        ulo, uhi = np.searchsorted(su, cell, "left"), np.searchsorted(su, cell, "right")
        vlo, vhi = np.searchsorted(sv, cell, "left"), np.searchsorted(sv, cell, "right")
        work = (uhi - ulo) * (vhi - vlo)
        # small cells: all their pairs at once; large ones by sorted blocks
        small = np.flatnonzero((work <= 4096) & (work > 0))
        at = 0
        total = np.r_[0, np.cumsum(work[small])]
        while at < len(small):
            to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            c = small[at:to]
            wide = (vhi - vlo)[c]
            rank = np.arange(work[c].sum()) - np.repeat(np.cumsum(work[c]) - work[c], work[c])
            w = np.repeat(wide, work[c])
            x, y = ou[np.repeat(ulo[c], work[c]) + rank // w], ov[np.repeat(vlo[c], work[c]) + rank % w]
            if v is None:
                keep = x < y
                x, y = x[keep], y[keep]
            x, y = fresh(*_counted(pu, pv, x, y, slack, need), r)
            for a in range(0, len(x), 1 << 15):
                i, j = x[a : a + (1 << 15)], y[a : a + (1 << 15)]
                ok = np.einsum("ij,ij->i", u[i], right[j]) >= threshold
                yield i[ok], j[ok]
            at = to
        for c in np.flatnonzero(work > 4096):
            mu, mv = ou[ulo[c] : uhi[c]], ov[vlo[c] : vhi[c]]
            for x, y in _blocks(pu[mu], pv[mv], u[mu], right[mv], slack, need, threshold, v is None):
                yield fresh(mu[x], mv[y], r)


class Components:
    """Components of n nodes from batches of edges, and the edges that form a spanning forest."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Most edges of a dense set lie within a component already and cost one comparison."""
        new = np.flatnonzero(self.of[x] != self.of[y])
        if not len(new):
            return
        a, b = self.of[x[new]], self.of[y[new]]
        _, one = np.unique(np.minimum(a, b) * len(self.of) + np.maximum(a, b), return_index=True)
        keep = one[forest(a[one], b[one])]
        self.edges.append((x[new[keep]], y[new[keep]]))
        low, high = np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])
        root = np.arange(len(self.of))
        while True:  # the least of each component, along the forest just found
            least = np.minimum(root[low], root[high])
            before = root.copy()
            np.minimum.at(root, low, least)
            np.minimum.at(root, high, least)
            root = root[root]
            if np.array_equal(root, before):
                break
        self.of = root[self.of]


def _floats(part: pd.DataFrame, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    v = np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64).astype(np.float64) for x in part["vec"]])
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def link_part(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one task: rows (a, b null, links of a) and forest edges (a, b, 0)."""
    empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "links": pd.Series(dtype="int64")})
    same = bool(pdf["same"].iat[0])
    pdf = pdf.sort_values("rep", kind="stable")  # one result however rows come
    left, right = (pdf, pdf) if same else (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])
    if len(left) == 0 or len(right) == 0 or len(pdf) < 2:
        return empty
    dim, bits, rep = int(pdf["dim"].iat[0]), int(pdf["bits"].iat[0]), int(pdf["rep_no"].iat[0])
    u = _floats(left, dim)
    v = u if same else _floats(right, dim)
    earlier = [(sides(u, bits, 900 + r), sides(v, bits, 900 + r)) for r in range(rep)]
    off = 0 if same else len(left)
    ids = left["rep"].to_numpy() if same else np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
    size = left["copies"].to_numpy() if same else np.concatenate([left["copies"].to_numpy(), right["copies"].to_numpy()])
    count, joined = np.zeros(len(ids), np.int64), Components(len(ids))
    for x, y in links(u, None if same else v, threshold):
        for su, sv in earlier:  # an earlier repetition has already had the pair
            keep = su[x] != sv[y]
            x, y = x[keep], y[keep]
        y = y + off
        np.add(count, np.bincount(x, size[y], len(ids)).astype(np.int64), out=count)
        np.add(count, np.bincount(y, size[x], len(ids)).astype(np.int64), out=count)
        joined.add(x, y)
    has = np.flatnonzero(count)
    if not len(has):
        return empty
    x, y = (np.concatenate([e[i] for e in joined.edges]) for i in (0, 1))
    a = np.concatenate([ids[has], ids[x]])
    b = pd.array(np.concatenate([np.zeros(len(has), np.int64), ids[y]]), dtype="Int64")
    b[: len(has)] = pd.NA
    return pd.DataFrame({"a": a, "b": b, "links": np.concatenate([count[has], np.zeros(len(x), "int64")])})


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label_key, dim, key, vec) of every row; key is null where the vector links with nothing."""

    def read(batches):
        for batch in batches:
            column = batch.column("embedding")
            values = column.flatten()
            narrow = pa.types.is_float32(values.type)
            flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float32 if narrow else np.float64) + 0.0
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            # a vector is usable if all its components are finite and one is not zero
            bad, some = np.r_[0, np.cumsum(~np.isfinite(flat))], np.r_[0, np.cumsum(flat != 0)]
            ok = (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
            data = [flat[e - n : e].tobytes() if k else None for e, n, k in zip(ends.tolist(), size.tolist(), ok.tolist(), strict=True)]
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data]
            dims = pa.array(np.where(ok, size, 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), dims, pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "label_key", "dim", "key", "vec"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label_key"), "embedding").mapInArrow(tidy(read), "vec_id long, label_key string, dim int, key binary, vec binary")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, task: int = TASK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = stored(_classes(vectors), "vectors")
    on = ["label_key", "dim", "key"]
    usable = rows.where(F.col("key").isNotNull() & F.col("vec_id").isNotNull() & F.col("label_key").isNotNull())
    # an id may stand for several classes (repeated rows of one id), so classes are numbered
    reps = usable.groupBy(*on).agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    sizes = reps.groupBy("label_key", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes

    def place(batches):
        for batch in batches:
            part_of = batch.to_pandas()
            for (dim, n), part in part_of.groupby(["dim", "n"]):
                bits, times = outer(int(n), threshold, task)
                v = _floats(part, int(dim)) if bits else np.zeros((len(part), 1))
                for r in range(times):
                    made = part.assign(bits=bits, rep_no=r, cell=sides(v, bits, 900 + r))
                    yield pa.RecordBatch.from_pandas(made[["label_key", "dim", "rep", "copies", "vec", "bits", "rep_no", "cell"]].astype({"dim": "int32", "bits": "int32", "rep_no": "int32", "cell": "int64"}), preserve_index=False)

    dealt = reps.join(sizes, ["label_key", "dim"]).select("label_key", "dim", "rep", "copies", "vec", "n").mapInArrow(tidy(place), "label_key string, dim int, rep long, copies long, vec binary, bits int, rep_no int, cell long")
    dealt = stored(dealt, "cells")
    where = ["label_key", "dim", "rep_no", "cell"]
    filled = dealt.groupBy(*where).agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("parts", F.ceil(F.col("m") / (2 * task)).cast("int"))
    filled = F.broadcast(filled) if filled.count() <= BROADCAST_ROWS else filled
    parted = dealt.join(filled, where).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = parted.select(
        *where, "rep", "copies", "vec", "bits", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), (F.col("part") == F.col("other")).alias("same")
    )
    found = cut(paired.groupBy(*where, "i", "j").applyInPandas(lambda pdf: link_part(pdf, threshold), "a long, b long, links long"))
    degree = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("id", "rep")
    known = reps.drop("vec").join(degree, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("vec_id").alias("least"))
    known = known.join(least, "component").select(*on, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "least")
    out = rows.drop("vec").withColumn("lone", F.col("vec_id").isNull()).join(known, on, "left")
    n_links = F.when(F.col("lone"), 0).otherwise(F.coalesce("links", F.lit(0))).cast("bigint")
    component = F.when(F.col("lone"), None).otherwise(F.coalesce("least", "vec_id")).cast("bigint")
    out = out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
