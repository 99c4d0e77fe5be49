"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct k-word shingles.  All shingles stand in one
global order: by how often their hash bucket occurs in the corpus, then by hash;
rare ones first.  The order is cut into fragments.  A pair's overlap is counted
in each fragment for itself and the partial counts are summed per pair, so no
task ever needs two whole documents, and the link test is exact.

Candidates: two sets of the required similarity share a shingle among their
first ``n - ceil(t * n) + 1`` in the global order.  The sets behind one such
shingle are a group; shingles with the same sets behind them are one group.  The
sets of a group are not paired with one another.  As the result is components,
candidates are proposed in rounds, and links found in a round are merged before
the next:

1. and 2.  every set proposes the nearest set of another component that it meets
   among some 256 of its group, dealt anew in each round;
3. sets outside the largest component of their group meet the whole group, and
   propose the nearest set of every other component;
4. the same sets propose all that is left.

"Near" is the Hamming distance of parity sketches, which never exceeds the number
of shingles two sets differ in: a pair whose sketches are too far apart cannot
link, and every pair that is not ruled out so has its overlap counted or ends up
inside one component.  Groups carry sketches of 512 bits; what they propose is
held against sketches as long as the sets ask for.  Rounds 1 and 2 grow with a
group, 3 and 4 with the product of a group and the part of it that joined nothing.

Documents of equal sets are one class and are compared once.

Edge cases: null or empty texts, and texts without words, have the empty set and
link with nothing; fewer words than k make one shingle; repeated rows of one id
are each given their class's component; a null id is linked like any other and
belongs to its class's component, or to none if no id is known there.  A very long
text is one set, cut into fragments like any other; equal overlaps and equal
sketches (ties) are ordered by set id.  Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sketch
from ._graph import components, merged
from ._session import cut, discard, stored, tidy
from ._text import U, binaries, chunks, mix, row_sets

FRAGMENTS = 4
BROADCAST_IDS = 1_000_000
BLOCK, WIDE = 256, 2048
SHORT = 8  # words of the sketches that groups carry
HOT_ROWS, HOT_PARTS = 1 << 16, 64


def prints(bounds: np.ndarray, values: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two prints of each set, from sums over its mixed members; 0 for the empty set.  The first has ``bits`` bits."""
    out = []
    size = np.diff(bounds)
    for salt in (0x51ED2705, 0x2545F491):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values * U(2 * salt + 1)), out=total[1:])
        out.append(np.where(size > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64)), U(0)))
    one = np.where(size > 0, out[0] >> U(64 - bits), U(0))
    return one.view(np.int64), mix(out[0] * U(0x9FB21C651E98DF25) + out[1]).view(np.int64)


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a set's sketch: a power of two, three to six a member, eight to sixteen for small sets."""
    want = np.maximum(size, 1) * np.where(size <= 256, 8, 3)
    return np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(want, 64 * SHORT))).astype(np.int64), 0)


def sketches(bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte bounds, bytes): bit b of a set's sketch is the parity of its members that fall on b."""
    size = np.diff(bounds)
    bits = sketch_bits(size)
    at = np.r_[0, np.cumsum(bits)]
    row = np.repeat(np.arange(len(size)), size)
    slot = mix(values ^ U(0xC3C3C3C3)).astype(np.int64) & (bits[row] - 1)
    flat = np.zeros(at[-1], np.uint8)
    place = np.sort(at[row] + slot)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    flat[place[first]] = np.diff(np.r_[first, len(place)]) & 1
    return at // 8, np.packbits(flat, bitorder="little")


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches (64-bit words) folded down to ``words`` words; distances never grow."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def sketch_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches, the larger one folded down; never above the true set difference."""
    a, b = (np.frombuffer(s, np.uint64).reshape(1, -1) for s in (x, y))
    words = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())


def _scan(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """One pass: a row for each document (prints, size, sketch, key of its text) and, at the end of a task, its bucket counts."""
    names = ["doc_id", "key", "one", "alt", "n", "sketch", "chunk", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        counts = np.zeros(_sketch.BUCKETS, np.uint32)
        for batch in batches:
            ids, key = batch.column("doc_id"), batch.column("key")
            for a, raw, offsets in chunks(batch.column("text")):
                bounds, values = row_sets(raw, offsets, k)
                counts += np.bincount(_sketch.bucket(values), minlength=_sketch.BUCKETS).astype(np.uint32)
                m = len(bounds) - 1
                one, alt = prints(bounds, values, bits)
                at, data = sketches(bounds, values)
                yield pa.RecordBatch.from_arrays([ids.slice(a, m), key.slice(a, m), pa.array(one), pa.array(alt), pa.array(np.diff(bounds).astype(np.int32)), binaries(at, data), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        rows = list(_sketch.chunk_rows(counts))
        m = len(rows)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(m, t) for t in kinds[:-2]], pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

    return _source(docs).mapInArrow(tidy(run), "doc_id long, key long, one long, alt long, n int, sketch binary, chunk int, counts binary")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _ids(one: np.ndarray, alt: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Set ids: the first print, or the longer one where two sets met in the first."""
    return np.where(np.isin(one, twice), alt, one) if len(twice) else one


def _prefixes(docs: DataFrame, k: int, percent: int, counts, twice: np.ndarray, bits: int) -> DataFrame:
    """(h, part, set_id, n): the first shingles of every set in the global order.

    ``part`` deals the sets behind a shingle of a very frequent bucket to several
    tasks (-1: not dealt); sets a task has just seen are not handed on again.
    """

    def run(batches):
        seen: set[int] = set()
        often = max(HOT_ROWS, 8 * int(counts.value.sum()) // _sketch.BUCKETS)
        for batch in batches:
            for _, raw, offsets in chunks(batch.column("text")):
                bounds, values = row_sets(raw, offsets, k)
                ids = _ids(*prints(bounds, values, bits), twice)
                n = np.diff(bounds)
                c = counts.value[_sketch.bucket(values)]
                order = np.lexsort((values, c, np.repeat(np.arange(len(n)), n)))
                values, c = values[order], c[order]
                if len(seen) > 100_000:
                    seen.clear()
                new = np.zeros(len(n), bool)
                for i in np.flatnonzero(n):
                    s = int(ids[i])
                    if s not in seen:
                        seen.add(s)
                        new[i] = True
                size = np.where(new, prefix_size(n, percent), 0)
                at = np.repeat(bounds[:-1], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                owner = np.repeat(ids, size)
                part = np.where(c[at] > often, (mix(owner.view(np.uint64)) & U(HOT_PARTS - 1)).astype(np.int64), -1)
                yield pa.RecordBatch.from_arrays([pa.array(values[at].view(np.int64)), pa.array(part.astype(np.int32)), pa.array(owner), pa.array(np.repeat(n, size).astype(np.int32))], ["h", "part", "set_id", "n"])

    return docs.select("text").mapInArrow(tidy(run), "h long, part int, set_id long, n int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Distinct rows (h, set_id, n) of shingles with two sets or more in sight; a stream over sorted rows, no group is held."""

    def run(batches):
        last = None  # the open shingle: (h, set, n, part, whether that row is still to be handed on)
        for batch in batches:
            h, s, n, part = (batch.column(c).to_numpy() for c in ("h", "set_id", "n", "part"))
            if not len(h):
                continue
            if last is not None:
                h, s, n, part = np.r_[last[0], h], np.r_[last[1], s], np.r_[last[2], n], np.r_[last[3], part]
            new_h = np.r_[True, h[1:] != h[:-1]]
            distinct = np.r_[True, new_h[1:] | (s[1:] != s[:-1])]
            group = np.cumsum(new_h) - 1
            many = (np.bincount(group[distinct]) > 1)[group] | (part >= 0)
            if last is not None and not last[4]:
                many |= group == 0
                distinct[0] = False
            out = distinct & many
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (h, s, n)], ["h", "set_id", "n"])
            last = (h[-1], s[-1], n[-1], part[-1], not many[-1])

    return prefixes.repartition("h", "part").sortWithinPartitions("h", "set_id").mapInArrow(tidy(run), "h long, set_id long, n int")


def _couples(groups: DataFrame, percent: int) -> DataFrame:
    """The candidates (a, b) of groups of two sets."""
    two = groups.where("m = 2").groupBy("g").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    return two.where(F.col("lo") * 100 >= F.col("hi") * percent).select("a", "b").distinct()


def _groups(shared: DataFrame) -> DataFrame:
    """(g, m, set_id): the sets behind shingles, one group for all shingles with the same sets; m sets each."""
    lists = shared.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"))
    kept = lists.where("m > 1").groupBy("m", "x", "y").agg(F.min("h").alias("h"))
    return shared.join(kept.select("h", "m"), "h").select(F.col("h").alias("g"), "m", "set_id", "n")


def _allowed(distance, nx, ny, percent: int):
    """Distance seen less distance allowed: |x & y| >= t / (100 + t) * (nx + ny), hence |x ^ y| <= (nx + ny) * (100 - t) / (100 + t)."""
    return distance * (100 + percent) - (nx + ny) * (100 - percent)


def _proposed(n, comp, role, sketch, how: str, percent: int, slab: int = 1 << 20):
    """(left, right) places of the candidates of one task, its sets in order of id: the "nearest" of each set, "each" other component's nearest of each probing set, or "all" of those."""
    every = np.arange(len(n))
    left, right = (every, every) if how == "nearest" else (np.flatnonzero(role == 1), np.flatnonzero(role == 0))
    if not len(left) or not len(right):
        return
    step = max(1, slab // len(right))
    for k in range(0, len(left), step):
        x = left[k : k + step]
        distance = np.zeros((len(x), len(right)), np.int32)
        for c in range(SHORT):
            distance += np.bitwise_count(sketch[x, c, None] ^ sketch[None, right, c])
        nx, ny = n[x][:, None], n[right][None, :]
        gap = _allowed(distance, nx, ny, percent)
        ok = (gap <= 0) & (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * percent) & (comp[x][:, None] != comp[right][None, :])
        if how == "nearest":
            best = np.where(ok, gap, 1).argmin(axis=1)
            has = ok[np.arange(len(x)), best]
            yield x[has], right[best[has]]
            continue
        i, j = np.nonzero(ok)
        if how == "each" and len(i):
            other = comp[right[j]]
            order = np.lexsort((j, gap[i, j], other, i))
            i, j, other = i[order], j[order], other[order]
            first = np.r_[True, (i[1:] != i[:-1]) | (other[1:] != other[:-1])]
            i, j = i[first], j[first]
        yield x[i], right[j]


def _candidates(rows: DataFrame, how: str, percent: int) -> DataFrame:
    """Distinct candidates (a, b) of rows (g, i, c, set_id, n, component, short, role), a task (g, i, c) at a time."""
    names = ["g", "i", "c", "set_id", "n", "component", "role"]

    def work(cols, sketch):
        key = np.stack(cols[:3])
        cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                ids = cols[3][a:b]
                out += [(ids[x], ids[y]) for x, y in _proposed(cols[4][a:b], cols[5][a:b], cols[6][a:b], sketch[a:b], how, percent) if len(x)]
        x, y = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        keep = x != y
        pairs = np.unique(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in names]
            sketch = np.frombuffer(b"".join(batch.column("short").to_pylist()), np.uint64).reshape(-1, SHORT)
            if held is not None:
                cols, sketch = [np.concatenate(z) for z in zip(held[0], cols, strict=True)], np.concatenate([held[1], sketch])
            # the last task's rows may go on in the next batch
            open_ = int(np.flatnonzero(np.r_[True, (np.stack(cols[:3])[:, 1:] != np.stack(cols[:3])[:, :-1]).any(axis=0)])[-1])
            if open_:
                yield work([z[:open_] for z in cols], sketch[:open_])
            held = [z[open_:] for z in cols], sketch[open_:]
        if held is not None:
            yield work(*held)

    dealt = rows.select(*names, "short").repartition("g", "i", "c").sortWithinPartitions("g", "i", "c", "set_id", "role")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that whole sketches leave possible."""
    s = sets.select("set_id", "n", "sketch")
    both = pairs.join(s.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            distance = [sketch_distance(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            gap = _allowed(np.array(distance, np.int64), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(gap <= 0))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def _short(sets: DataFrame) -> DataFrame:
    """(set_id, short): sketches folded to SHORT words."""

    def run(batches):
        for batch in batches:
            short = [folded(np.frombuffer(x, np.uint64).reshape(1, -1), SHORT).tobytes() for x in batch.column("sketch").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(short, pa.binary())], ["set_id", "short"])

    return sets.select("set_id", "sketch").mapInArrow(tidy(run), "set_id long, short binary")


def _blocks(rows: DataFrame, salt: int) -> DataFrame:
    """Groups dealt at random into blocks of about BLOCK sets."""
    block = F.pmod(F.xxhash64("set_id", "g", F.lit(salt)), F.ceil(F.col("m") / BLOCK))
    return rows.withColumns({"i": block, "c": F.lit(0).cast("long"), "role": F.lit(0)})


def _probes(rows: DataFrame) -> DataFrame:
    """Of each group: the sets outside its largest component (role 1) beside all its sets (role 0), in bounded blocks of both."""
    sizes = rows.groupBy("g", "component").agg(F.count(F.lit(1)).alias("w"))
    main = sizes.groupBy("g").agg(F.max(F.struct("w", "component")).alias("top"), F.sum("w").alias("m2"))
    main = main.select("g", F.col("top.component").alias("main"), F.ceil(F.col("m2") / WIDE).alias("own"), F.ceil((F.col("m2") - F.col("top.w")) / WIDE).alias("odd"))
    both = rows.join(main, "g")
    own = both.select("*", F.pmod(F.xxhash64("set_id"), "own").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("odd") - 1)).alias("c"), F.lit(0).alias("role"))
    odd = both.where("component != main").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("i"), F.pmod(F.xxhash64("set_id", F.lit(7)), "odd").alias("c"), F.lit(1).alias("role"))
    return own.unionByName(odd)


def _fragments(docs: DataFrame, wanted: DataFrame, k: int, counts, pivots: np.ndarray, twice: np.ndarray, bits: int) -> DataFrame:
    """(set_id, f, members) of the texts whose key is wanted: each set's part in each fragment of the global order."""
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    source = _source(docs).join(wanted, "key", "left_semi").select("text")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, raw, offsets in chunks(batch.column("text")):
                bounds, values = row_sets(raw, offsets, k)
                ids = _ids(*prints(bounds, values, bits), twice)
                m = len(bounds) - 1
                new = np.zeros(m, bool)
                for i, s in enumerate(ids.tolist()):
                    if s not in seen:
                        new[i] = True
                        seen.add(s)
                if len(seen) > 100_000:
                    seen.clear()
                row = np.repeat(np.arange(m), np.diff(bounds))
                f = np.searchsorted(pivots, counts.value[_sketch.bucket(values)], "right")
                order = np.lexsort((values, f, row))
                cuts = np.searchsorted(row[order] * FRAGMENTS + f[order], np.arange(m * FRAGMENTS + 1))
                keep = (np.diff(cuts) > 0) & np.repeat(new, FRAGMENTS)
                rows = pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), m)), binaries(cuts, values[order])], ["set_id", "f", "members"])
                yield rows.filter(pa.array(keep))

    return source.mapInArrow(tidy(run), "set_id long, f int, members binary")


def _overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, overlap): partial counts of each fragment, summed per pair."""

    def flat(col):
        offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        return np.frombuffer(col.buffers()[2], np.uint64, (offs[-1] - offs[0]) // 8, offs[0]), np.diff(offs) // 8

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                vx, nx = flat(batch.column("mx"))
                vy, ny = flat(batch.column("my"))
                row = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)])
                v = np.concatenate([vx, vy])
                order = np.lexsort((v, row))
                v, row = v[order], row[order]
                out = np.bincount(row[1:][(v[1:] == v[:-1]) & (row[1:] == row[:-1])], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out.astype(np.int64))], ["a", "b", "part"])

    left = parts.select(F.col("set_id").alias("a"), F.col("f").alias("f2"), F.col("members").alias("mx"))
    right = parts.select(F.col("set_id").alias("b"), F.col("f").alias("f2"), F.col("members").alias("my"))
    both = pairs.select("a", "b").join(left, "a").join(right, ["b", "f2"]).select("a", "b", "mx", "my")
    return both.mapInArrow(tidy(run), "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("overlap"))


def _pivots(counts: np.ndarray) -> np.ndarray:
    """Bucket counts that cut all occurrences into FRAGMENTS parts of about equal weight."""
    order = np.sort(counts)
    weight = np.cumsum(order)
    if not len(order) or not weight[-1]:
        return np.arange(1, FRAGMENTS)
    return order[np.searchsorted(weight, weight[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)]


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, print_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    out = _placed(docs, k, percent, print_bits)
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _placed(docs: DataFrame, k: int, percent: int, print_bits: int = 64) -> DataFrame:
    """(doc_id, key, n, group, component_id): every row with the key of its text, the component of its set, and the smallest id there."""
    spark = docs.sparkSession
    scan = stored(_scan(docs, k, print_bits), "sets")
    counts_array = _sketch.add_up(scan.where(F.col("chunk").isNotNull()), "uint32", _sketch.BUCKETS)
    counts = spark.sparkContext.broadcast(counts_array)  # BUCKETS numbers, whatever the corpus
    pivots = _pivots(counts_array)
    rows = scan.where(F.col("chunk").isNull()).drop("chunk", "counts")
    # the id of a class is its first print; of sets that met there by chance (about one in 10^10 sets) the longer one
    classes = stored(rows.where("n > 0").groupBy("one", "alt").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    twice = np.array([r["one"] for r in classes.groupBy("one").count().where("count > 1").select("one").collect()], np.int64)
    set_id = (F.when(F.col("one").isin(twice.tolist()), F.col("alt")).otherwise(F.col("one")) if len(twice) else F.col("one")).alias("set_id")
    sets = classes.select(set_id, "doc_id", "key", "n", "sketch")
    shared = stored(_shared(_prefixes(docs, k, percent, counts, twice, print_bits)), "prefixes")
    groups = stored(_groups(shared), "groups")
    discard(shared)
    large = stored(groups.where("m > 2").join(_short(sets), "set_id"), "large")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that link: overlap counted by fragments, exact."""
        ids = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        wanted = cut(sets.select("set_id", "key", "n").join(ids, "set_id", "left_semi"))
        parts = stored(_fragments(docs, wanted.select("key").distinct(), k, counts, pivots, twice, print_bits).groupBy("set_id", "f").agg(F.first("members").alias("members")), "fragments")
        size = wanted.select("set_id", "n")
        found = _overlaps(pairs, parts).join(size.select(F.col("set_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("set_id").alias("b"), F.col("n").alias("nb")), "b")
        found = cut(found.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent).select("a", "b"))
        discard(parts)
        return found

    comp = tried = None
    for turn, how in enumerate(("nearest", "nearest", "each", "all")):
        placed = large.withColumn("component", F.col("set_id"))
        if comp is not None:
            placed = large.join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
            mixed = placed.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("g")
            placed = cut(placed.join(mixed, "g", "left_semi"))
            if placed.isEmpty():  # every group lies inside one component
                break
        pairs = _candidates(_blocks(placed, turn) if how == "nearest" else _probes(placed), how, percent)
        pairs = pairs.join(tried, ["a", "b"], "left_anti") if turn else pairs.unionByName(_couples(groups, percent)).distinct()
        pairs = cut(_measured(pairs, sets, percent))
        tried = tried.unionByName(pairs) if turn else pairs
        if not pairs.isEmpty():
            links = verified(pairs)
            comp = cut(components(links) if comp is None else merged(comp, links))
    discard(groups, large)
    if comp is None:
        known = sets.select("set_id", F.col("set_id").alias("group"), F.col("doc_id").alias("component_id"))
    else:
        named = sets.select("set_id", "doc_id").join(comp.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("group", F.coalesce("component", "set_id"))
        least = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
        known = named.join(least, "group").select("set_id", "group", "component_id")
    return rows.select("doc_id", "key", "n", set_id).join(known, "set_id", "left").select("doc_id", "key", "n", "group", "component_id")


def representatives(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Rows of ``docs`` (all columns) without those that stand for no group: the smallest id of each component stays, once.

    Of a component without any id one row stays, the first by the hash of its text.  Rows without words all stay.
    """
    found = cut(_placed(docs.select("doc_id", "text"), k, percent).where("n > 0"))
    kept = _without(docs, "doc_id", found.where(F.col("doc_id").isNotNull()).withColumn("gone", F.col("doc_id") != F.col("component_id")), docs["doc_id"])
    loose = found.where(F.col("doc_id").isNull())
    if loose.isEmpty():
        return kept
    first = loose.groupBy("group").agg(F.min("key").alias("first"))
    loose = loose.join(first, "group").withColumn("gone", F.col("component_id").isNotNull() | (F.col("key") != F.col("first")))
    known = kept.where(F.col("doc_id").isNotNull())
    return known.unionByName(_without(kept.where(F.col("doc_id").isNull()), "key", loose, F.xxhash64(kept["text"])))


def _without(docs: DataFrame, name: str, judged: DataFrame, value) -> DataFrame:
    """Rows of ``docs`` whose ``value`` is not gone by (name, gone), and one row of each value that was judged more than once."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), value.alias(name))
    gone = judged.where("gone").select(name).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = rows.join(gone, name, "left_anti")
    again = judged.where(~F.col("gone")).groupBy(name).count().where("count > 1").select(name)
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, name, "left_semi").groupBy(name).agg(F.first("row").alias("row"))
    return kept.join(again, name, "left_anti").select("row.*").unionByName(once.select("row.*"))
