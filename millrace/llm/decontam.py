"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are words of letters, digits and non-ASCII bytes, lower-cased.  A document
holds an item of n words if some run of its words is within ``floor((1 - s) * n)``
word edits of the item (items of fewer than five words: exactly).

1. An item of more than PIECE words is cut into pieces of about equal length.  Its
   edits are spread over the pieces, so a run within the allowance of the item is
   within the allowance of some piece, at the same similarity.  A shorter item is
   one piece.
2. Every start in every document is a window of each piece's size.  A window at the
   start of such a run has at least ``m - 1 - 2k`` word pairs of pieces of m words
   in reach; all other windows are passed over, which loses nothing.
3. The others are embedded by the CGK random walk (a shared pointer advances by a
   random bit of step and word), which turns edits into Hamming distance.
   ``BITS`` sampled positions of a walk form a key.  The keys are looked up among
   those of all pieces of that size: windows that share a key with a piece are its
   candidates.  Repetitions are as many as a simulation with the most edits
   allowed needs for RECALL, for each size.
4. Candidates are verified by exact edit distance of the whole item to the best run
   in the surroundings.

The items are taken in blocks of bounded size, one pass over the documents each,
and only a block is ever broadcast.

Edge cases: null or empty texts and items match nothing; rows without an id are
searched like others and reported under a null id; repeated rows give the same
result for each; items without words are left out; of several places with the
fewest edits (ties) the first counts; a very long text is searched whole.  Columns
other than doc_id and text (item_id and text) are not read by the search and
pass through ``decontaminate`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import stored, tidy
from ._text import U, chunks, hashes, mix, spans

SIMILARITY, BITS, RECALL, PIECE = 0.8, 2, 0.99, 48
CASES, TRIES = 160, 64
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
OTHER = np.ones(256, bool)
OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def allowed(n: np.ndarray | int, similarity: float):
    """Most edits of an item of n words."""
    return np.where(np.asarray(n) < 5, 0, np.floor((1 - similarity) * np.asarray(n) + 1e-9)).astype(int)


def kept_pairs(n: int, similarity: float) -> int:
    """Fewest word pairs of n words that survive the edits allowed (each edit destroys two at most)."""
    return max(min(1, n - 1), n - 1 - 2 * int(allowed(n, similarity)))


def pieces(n: int) -> list[tuple[int, int]]:
    """(offset, words) of the pieces of an item of n words."""
    cuts = [len(part) for part in np.array_split(np.arange(n), -(-n // PIECE))]
    return list(zip(np.r_[0, np.cumsum(cuts)[:-1]].tolist(), cuts, strict=True))


def walk(windows: np.ndarray, repeat: np.ndarray, upto: int) -> np.ndarray:
    """CGK: the first ``upto`` symbols of the random walk over each row, by its repetition (0 beyond its end)."""
    at = np.zeros(len(windows), np.int64)
    padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], axis=1)
    rows, end = np.arange(len(windows)), windows.shape[1]
    seed = repeat.astype(np.uint64) * U(0x85EBCA6B)
    out = np.empty((len(windows), upto), np.uint64)
    for j in range(upto):
        c = padded[rows, at]
        out[:, j] = c
        at = np.minimum(end, at + (mix(c + seed + U(j * 0x9E3779B1)) & U(1)).astype(np.int64))
    return out


def sampled(n: int, repeats: int) -> np.ndarray:
    """Positions looked at by each repetition for windows of n words; walks seldom end before the last of them."""
    rng = np.random.default_rng([n, 77])
    return np.stack([np.sort(rng.choice(max(BITS, int(1.6 * n)), BITS, replace=False)) for _ in range(repeats)])


def keys(windows: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """(windows, repetitions): the key of every repetition of every window, all of one size."""
    n, reps = windows.shape[1], len(positions)
    out = np.empty((len(windows), reps), np.uint64)
    step = max(1, (1 << 14) // reps)
    for a in range(0, len(windows), step):
        part = windows[a : a + step]
        row, repeat = np.repeat(np.arange(len(part)), reps), np.tile(np.arange(reps), len(part))
        at = positions[repeat]
        seen = walk(part[row], repeat, int(at.max()) + 1)
        acc = mix(repeat.astype(np.uint64) + U(1) + U(n << 32))
        for j in range(BITS):
            acc = mix(acc * U(0x9FB21C651E98DF25) + seen[np.arange(len(seen)), at[:, j]])
        out[a : a + step] = acc.reshape(len(part), reps)
    return out


def changed(words: np.ndarray, edits: int, rng) -> list:
    """``words`` after that many random substitutions, deletions and insertions."""
    out = list(words)
    for _ in range(edits):
        p, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        out[p : p + (kind > 0)] = [] if kind == 1 else [np.uint64(rng.integers(1, 1 << 62))]
    return out


def repeats(table: np.ndarray, similarity: float, seed: int = 5) -> int:
    """Repetitions that find RECALL of the windows with the most edits allowed, by simulation over pieces of one size.

    Each case has its own chance of a common key; a case that met in no try
    counts as half a meeting, and the expected loss is what must fall below 1 - RECALL.
    """
    n = table.shape[1]
    k = int(allowed(n, similarity))
    if not k:
        return 1
    rng = np.random.default_rng([seed, n])
    base = table[rng.integers(0, len(table), CASES)]
    other = np.stack([np.array((changed(row, k, rng) + [np.uint64(0)] * n)[:n], np.uint64) for row in base])
    positions = sampled(n, TRIES)
    chance = np.maximum((keys(base, positions) == keys(other, positions)).mean(axis=1), 0.5 / TRIES)
    low, high = 0, 1
    while ((1 - chance) ** high).mean() > 1 - RECALL:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if ((1 - chance) ** mid).mean() > 1 - RECALL else (low, mid)
    return high


def edits(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(fewest word edits between the item and any run of the region, end of the first such run)."""
    line = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for w in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (region != w), row[1:] + 1)
        row = np.minimum.accumulate(new - line) + line
    end = int(row.argmin())
    return int(row[end]), end


def pair_hash(w: np.ndarray) -> np.ndarray:
    return mix(w[:-1] * U(0x9FB21C651E98DF25) + w[1:])


def _spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one after the other."""
    size = np.maximum(end - start, 0)
    return np.repeat(start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))


@dataclass
class Size:
    """The pieces of one size: their word pairs, and the keys of all of them."""

    words: int
    known: np.ndarray  # sorted hashes of their word pairs (of the word itself where a piece has one word)
    positions: np.ndarray
    table: np.ndarray  # sorted keys
    owner: np.ndarray  # piece of each key

    def windows(self, at: np.ndarray, first: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
        """Starts of the windows with enough pairs in reach, from the places ``at`` where known pairs stand; ``first`` and ``last`` bound the row of each word."""
        m, k, need = self.words, int(allowed(self.words, similarity)), max(1, kept_pairs(self.words, similarity))
        if len(at) < need:
            return np.zeros(0, np.int64)
        a, b = at[: len(at) - need + 1], at[need - 1 :]
        ok = (b - a < m + k - 1 + (m == 1)) & (first[a] == first[b])
        a, b = a[ok], b[ok]
        starts = _spread(np.maximum(b - (m + k - 1) + 1 - (m == 1), first[a]), a + 1)
        starts = np.unique(starts)
        return starts[starts + m - k <= last[starts]]


@dataclass
class Index:
    """One block of items."""

    ids: list[int]
    words: list[np.ndarray]
    similarity: float
    item: np.ndarray  # item of each piece
    offset: np.ndarray  # where each piece begins in its item
    sizes: list[Size]
    bitmap: np.ndarray  # which low bits of a pair's hash occur at all

    @classmethod
    def build(cls, items: list[tuple[int, str]], similarity: float) -> Index:
        ids, words = [], []
        for item, text in items:
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            starts, ends, _ = spans(raw, np.array([0, len(raw)]), OTHER)
            if len(starts):
                ids.append(item)
                words.append(hashes(raw, starts, ends))
        cuts = [(i, offset, n) for i, w in enumerate(words) for offset, n in pieces(len(w))]
        item, offset, length = (np.array(x, np.int64) for x in zip(*cuts, strict=True)) if cuts else (np.zeros(0, np.int64),) * 3
        sizes, bitmap = [], np.zeros(1 << 22, bool)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            windows = np.stack([words[item[i]][offset[i] : offset[i] + n] for i in own])
            positions = sampled(n, repeats(windows, similarity))
            flat, owner = keys(windows, positions).ravel(), np.repeat(own, len(positions))
            order = np.argsort(flat, kind="stable")
            known = np.unique(np.concatenate([pair_hash(w) for w in windows]) if n > 1 else windows.ravel())
            sizes.append(Size(n, known, positions, flat[order], owner[order]))
            if n > 1:
                bitmap[(known & U(len(bitmap) - 1)).astype(np.int64)] = True
        return cls(ids, words, similarity, item, offset, sizes, bitmap)

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, start word, edits, item words): the best place of each item in each row."""
        starts, ends, rows = spans(raw, offsets, OTHER)
        if not len(starts) or not self.words:
            return []
        w = hashes(raw, starts, ends)
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        length = np.diff(np.r_[head, len(rows)])
        first, last = np.repeat(head, length), np.repeat(head + length, length)
        pair = pair_hash(w)
        maybe = np.flatnonzero(self.bitmap[(pair & U(len(self.bitmap) - 1)).astype(np.int64)] & (rows[1:] == rows[:-1])) if len(w) > 1 else np.zeros(0, np.int64)
        found: dict[tuple[int, int], list[int]] = {}
        for size in self.sizes:
            places, seen = (maybe, pair[maybe]) if size.words > 1 else (np.arange(len(w)), w)
            spot = np.minimum(np.searchsorted(size.known, seen), len(size.known) - 1)
            at = size.windows(places[size.known[spot] == seen], first, last, self.similarity)
            for a in range(0, len(at), 1 << 12):
                self._look_up(size, w, at[a : a + (1 << 12)], last, rows, found)
        bounds = dict(zip(rows[head].tolist(), zip(head.tolist(), (head + length).tolist(), strict=True), strict=True))
        return [r for (row, item), places in found.items() if (r := self._verify(row, item, places, w, *bounds[row]))]

    def _look_up(self, size: Size, w, at, last, rows, found) -> None:
        """Candidates by LSH: the pieces that share a key with the windows at ``at``."""
        cols = at[:, None] + np.arange(size.words)[None, :]
        windows = np.where(cols < last[at][:, None], w[np.minimum(cols, len(w) - 1)], U(0))
        k = keys(windows, size.positions)
        lo, hi = np.searchsorted(size.table, k.ravel(), "left"), np.searchsorted(size.table, k.ravel(), "right")
        piece = size.owner[_spread(lo, hi)]
        window = np.repeat(np.repeat(np.arange(len(at)), k.shape[1]), hi - lo)
        for code in np.unique(window * len(self.item) + piece).tolist():
            p, i = int(at[code // len(self.item)]), code % len(self.item)
            found.setdefault((int(rows[p]), int(self.item[i])), []).append(p - int(self.offset[i]))

    def _verify(self, row, item, places, w, begin, stop):
        target = self.words[item]
        n, k = len(target), int(allowed(len(target), self.similarity))
        best = None
        for p, q in _regions(sorted(set(places)), n):
            a, b = max(begin, p - k), min(stop, q + n + 2 * k)
            d, end = edits(target, w[a:b])
            if d <= k and (best is None or d < best[0]):
                best = (d, max(begin, a + end - n))
        return None if best is None else (row, self.ids[item], best[1] - begin, best[0], n)


def _regions(places: list[int], n: int):
    a = b = places[0]
    for p in places[1:]:
        if p > b + n:
            yield a, b
            a = p
        b = p
    yield a, b


def blocks(items: DataFrame):
    """Lists of (item_id, text), each of bounded size, fetched one at a time."""
    part, words = [], 0
    for r in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        size = len(r["text"].split())
        if part and (len(part) >= BLOCK_ITEMS or words + size > BLOCK_WORDS):
            yield part
            part, words = [], 0
        part.append((r["item_id"], r["text"]))
        words += size
    if part:
        yield part


SCHEMA = "doc_id long, item_id long, start_word long, edits int, item_words int"


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, edits, item_words): the best place of each item that a row of ``docs`` holds."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for part in blocks(items):
        index = spark.sparkContext.broadcast(Index.build(part, similarity))
        found = source.mapInArrow(_searcher(index), SCHEMA)
        if len(part) >= BLOCK_ITEMS or out is not None:  # perhaps not the only block: one at a time in memory
            found = stored(found, "leaks")
            index.unpersist()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def _searcher(index):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            got = []
            for a, raw, offsets in chunks(batch.column("text"), 1 << 20):
                got += [(ids[a + row], *rest) for row, *rest in index.value.search(raw, offsets)]
            cols = list(zip(*got, strict=True)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "start_word", "edits", "item_words"])

    return tidy(run)


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` (all columns) that hold no item; decided where each row is read, without a shuffle.

    With more than one block of items, what a block leaves is written before the next.
    """
    spark = docs.sparkSession
    out, index = docs, None
    for part in blocks(items):
        if index is not None:
            out = stored(out, "clean")
            index.unpersist()
        index = spark.sparkContext.broadcast(Index.build(part, similarity))
        out = out.mapInArrow(_keeper(index), docs.schema)
    return out


def _keeper(index):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, raw, offsets in chunks(batch.column("text"), 1 << 20):
                for row, *_ in index.value.search(raw, offsets):
                    keep[a + row] = False
            yield batch.filter(pa.array(keep))

    return tidy(run)
