"""Phrase mining on compressed position bitmaps, shard by shard.

Texts are packed into shards of some ``SHARD_BYTES``.  In a shard all words stand at
successive positions, with a free position at every piece and document boundary;
a word's bitmap is the sorted list of its non-empty blocks of ``WIDTH`` positions.
A phrase is extended by shifting its bitmap by one place and taking the AND with
the bitmaps of the words in the same blocks; the popcount of what is left is the
local count of the longer phrase.  A range of words is extended to its longest
phrases before the next range begins (depth first), so memory follows the range.
Boundaries hold no word, so no phrase crosses one.

Two passes sum popcounts over shards.  The first sends a 48-bit hash and a clipped
count of every local pair, and finds the hashes that may reach ``least``: nothing
is lost, equal hashes only let a pair pass.  Those go back to the shards that hold
them, and the second pass sends the exact counts of all words, of those pairs, and
of the longer phrases all of whose pairs are among them.

Scores are whole numbers, divided exactly as decimals (counts up to 10^15).

Edge cases: a null or empty text has no word; a null lang is ``und``; repeated rows
count each; a text longer than a shard is cut at a piece boundary; ties of score and
count go by the phrase's bytes; an empty table gives no row.  Columns other than
lang and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._session import stored, tidy
from ._text import U, hashes, mix

SHARD_BYTES, WIDTH, MEETINGS = 8 << 20, 16, 1 << 20
SALTS = 32
#: Bytes at which texts are split into pieces.
SPLITS = b".,;:!?\n\x0b\x0c\r"
_GAP = b"\xff"  # never part of UTF-8
_TABLE = bytes.maketrans(bytes(range(65, 91)) + SPLITS + b"\t", bytes(range(97, 123)) + _GAP * len(SPLITS) + b" ")
_SPLIT = re.compile(b"[" + SPLITS + b"]")
_SHARD = "shard long, langs array<string>, firsts array<int>, words binary, ids binary, sizes array<int>"


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about SHARD_BYTES, cut at piece boundaries."""
    at = 0
    while at < len(raw):
        end = _SPLIT.search(raw, at + SHARD_BYTES)
        to = end.end() if end else len(raw)
        yield raw[at:to]
        at = to


def _packed(shard: int, held: dict[str, list[bytes]]) -> pa.RecordBatch:
    """One row: the words of each language, and the word id at every position (-1: none)."""
    words, ids, firsts, first = [], [], [], 0
    for texts in held.values():
        tokens = _GAP.join(texts).translate(_TABLE).replace(_GAP, b" " + _GAP + b" ").split()
        coded = pa.array([*tokens, _GAP], pa.binary()).dictionary_encode()
        own, places = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        gap = own.index(_GAP)
        ids.append(np.where(places == gap, -1, places + first).astype(np.int32))
        words += own  # the mark of a gap keeps a place that nothing refers to
        firsts.append(first)
        first += len(own)
    joined, at = b"\n".join(words), np.concatenate(ids).tobytes()
    row = [shard, list(held), firsts, pa.compress(joined, "zstd", asbytes=True), pa.compress(at, "zstd", asbytes=True), [len(joined), len(at)]]
    types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["shard", "langs", "firsts", "words", "ids", "sizes"])


def shards(docs: DataFrame) -> DataFrame:
    """The texts packed into shards, one row each."""

    def pack(batches):
        number, held, size = TaskContext.get().partitionId() << 24, {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for part in _parts(text.as_py() or b""):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= SHARD_BYTES:
                        yield _packed(number, held)
                        number, held, size = number + 1, {}, 0
        if held:
            yield _packed(number, held)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(tidy(pack), _SHARD), "shards")


class Bitmaps:
    """The bitmaps of a shard's words, by word and by block."""

    def __init__(self, row: dict) -> None:
        self.langs, self.firsts = row["langs"], np.array(row["firsts"])
        self.words = pa.decompress(row["words"], row["sizes"][0], "zstd", asbytes=True).split(b"\n")
        ids = np.frombuffer(pa.decompress(row["ids"], row["sizes"][1], "zstd", asbytes=True), np.int32)
        self.lang_of = np.searchsorted(self.firsts, np.arange(len(self.words)), "right") - 1
        places = np.flatnonzero(ids >= 0)
        word = ids[places]
        order = np.argsort(word, kind="stable")
        places, word = places[order], word[order].astype(np.int64)
        block = places // WIDTH
        self.blocks = len(ids) // WIDTH + 2
        first = _starts(word * self.blocks + block)
        self.word, self.block = word[first], block[first]
        self.mask = np.add.reduceat(np.left_shift(np.uint16(1), (places % WIDTH).astype(np.uint16), dtype=np.uint16), first, dtype=np.uint16) if len(first) else np.zeros(0, np.uint16)
        by = np.argsort(self.block, kind="stable")
        self.by_word, self.by_mask = self.word[by].astype(np.int32), self.mask[by]
        self.bound = np.searchsorted(self.block[by], np.arange(self.blocks + 1))

    def word_hashes(self) -> np.ndarray:
        """64-bit hashes of (language, word)."""
        raw = np.frombuffer(b"".join(self.words), np.uint8)
        ends = np.cumsum([len(w) for w in self.words])
        lang = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        return mix(hashes(raw, np.concatenate([[0], ends[:-1]]), ends) + lang[self.lang_of])

    def ranges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, block, mask) for one range of words after the other, each with about MEETINGS blocks of other words to meet."""
        if not len(self.word):
            return
        heads = np.append(_starts(self.word), len(self.word))
        met = np.concatenate([[0], np.cumsum(self.bound[self.block + 1] - self.bound[self.block])])[heads]
        i = 0
        while i < len(heads) - 1:
            j = max(i + 1, int(np.searchsorted(met, met[i] + MEETINGS, "right")) - 1)
            at = slice(heads[i], heads[j])
            yield self.word[at], self.block[at], self.mask[at]
            i = j

    def extended(self, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, block, mask): bitmaps shifted by one place, AND the bitmap of each word there."""
        over = np.flatnonzero(mask >> np.uint16(WIDTH - 1))
        phrase, block = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1])
        mask = np.concatenate([mask << np.uint16(1), np.ones(len(over), np.uint16)])
        low, n = self.bound[block], self.bound[block + 1] - self.bound[block]
        row = np.repeat(np.arange(len(block), dtype=np.int32), n)
        there = np.arange(len(row)) + np.repeat(low - (np.cumsum(n) - n), n)
        both = mask[row] & self.by_mask[there]
        hit = np.flatnonzero(both)
        row, there = row[hit], there[hit]
        return phrase[row], self.by_word[there], block[row], both[hit]


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _grouped(phrase: np.ndarray, word: np.ndarray, block: np.ndarray, mask: np.ndarray, vocabulary: int):
    """Longer phrases as (phrase, word, popcount), and their bitmaps as (number, block, mask)."""
    key = phrase.astype(np.int64) * vocabulary + word
    order = np.argsort(key, kind="stable")
    first = _starts(key[order])
    bits = np.bitwise_count(mask[order]).astype(np.int64)
    count = np.add.reduceat(bits, first) if len(first) else bits
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return phrase[order][first], word[order][first], count, (number, block[order], mask[order])


def _pair_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(mix(h[a]) * U(0x9FB21C651E98DF25) + h[b]) >> U(16)).view(np.int64)


def _pair_rows(least: int):
    """Of each shard, (h, at) for every pair: the hash, and shard x 256 + the count, clipped at ``least``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                maps = Bitmaps(row)
                h = maps.word_hashes()
                for own in maps.ranges():
                    a, b, n, _ = _grouped(*maps.extended(*own), len(maps.words))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(_pair_hash(h, a, b)), pa.array(row["shard"] * 256 + np.minimum(n, least))], ["h", "at"])

    return run


_COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _counted(longest: int):
    """Of a shard, (lang, phrase, n): its words, its live pairs and the phrases made of them; a null phrase counts all words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _COUNT.empty_table()
        maps = Bitmaps(left.to_pylist()[0])
        live, h = np.sort(right.column("h").to_numpy()), maps.word_hashes()
        texts, langs = pa.array(maps.words, pa.binary()), pa.array(maps.langs, pa.string())
        out: list[tuple] = []

        def alive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = _pair_hash(h, a, b)
            return np.zeros(len(key), bool) if not len(live) else live[np.minimum(np.searchsorted(live, key), len(live) - 1)] == key

        def add(words: list[np.ndarray], n: np.ndarray) -> None:
            joined = pc.binary_join_element_wise(*[texts.take(pa.array(w)) for w in words], b" ") if len(words) > 1 else texts.take(pa.array(words[0]))
            out.append((langs.take(pa.array(maps.lang_of[words[0]])), joined.cast(pa.string()), pa.array(n)))

        heads = _starts(maps.word)
        if len(heads):
            n = np.add.reduceat(np.bitwise_count(maps.mask).astype(np.int64), heads)
            own = maps.word[heads]
            add([own], n)
            total = np.bincount(maps.lang_of[own], n, len(maps.langs)).astype(np.int64)
            out.append((langs, pa.nulls(len(langs), pa.string()), pa.array(total)))
        for own in maps.ranges():
            words, now, last = None, own, own[0]
            for _ in range(longest - 1):
                phrase, word, block, mask = maps.extended(*now)
                ok = alive(last[phrase] if words else phrase, word)
                phrase, word, n, now = _grouped(phrase[ok], word[ok], block[ok], mask[ok], len(maps.words))
                if not len(phrase):
                    break
                words = [w[phrase] for w in words] + [word] if words else [phrase, word]
                last = word
                add(words, n)
        if not out:
            return _COUNT.empty_table()
        return pa.Table.from_arrays([pa.chunked_array([x[i] for x in out]) for i in range(3)], schema=_COUNT)

    return run


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """(lang, phrase, n): all words and phrases of up to ``longest`` words found ``least`` times in a language; a null phrase has the sum of all words."""
    packed = shards(docs)
    pairs = packed.mapInArrow(tidy(_pair_rows(least)), "h long, at long")
    whole = F.sum(F.col("at") % 256).over(Window.partitionBy("h"))
    live = pairs.withColumn("n", whole).where(F.col("n") >= least).select(F.expr("at div 256").alias("shard"), "h")
    local = packed.groupBy("shard").cogroup(live.groupBy("shard")).applyInArrow(_counted(longest), "lang string, phrase string, n long")
    counts = local.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counts.where(F.col("phrase").isNull() | (F.col("n") >= least))


def _score(a: str, left: str, right: str) -> F.Column:
    """floor(10^6 a a / (left right)), exactly."""
    a, left, right = (f"CAST({c} AS DECIMAL(15,0))" for c in (a, left, right))
    return F.expr(f"({a} * {a} * CAST(1000000 AS DECIMAL(7,0))) div ({left} * {right})")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language that no longer phrase covers to ``share`` percent."""
    counts = stored(phrase_counts(docs, least, longest), "phrases")
    known = counts.where(F.col("phrase").isNotNull())
    words = F.split("phrase", " ")
    phrases = known.select("lang", "phrase", F.col("n").alias("a"), words.alias("w")).where(F.size("w") > 1)
    size = F.size("w")

    def part(first, length):
        return F.array_join(F.slice("w", first, length), " ")

    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)), ["lang", side])
    lowest = cuts.groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r")).alias("cut"))

    inside = phrases.where(size > 2).select("lang", "a", "w", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i"))
    covering = inside.select("lang", part(F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(covering, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    scored = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    total = counts.where(F.col("phrase").isNull()).select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
