"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is its 128-bit digest after stripping ``[\\x20\\x09-\\x0D]`` at both
ends and lower-casing A-Z; lines under ``min_chars`` code points have none.  The
exact tables are the postings (key, document) and, summed from them, the
reference counts (key, n_docs, last_doc).  Keys held by ``min_docs`` documents
also stand in cuckoo filters, one per shard of the key space.  A document none
of whose lines hits a filter is finished where it is read; only the others
consult the exact tables, so a false positive costs time and never a line.  Filters
are sent to all tasks as far as ``filter_limit`` goes; beyond it the keys are dealt
to the filters instead, shard by shard, frequent lines over several copies.

Insertions append postings, deletions take postings away, and both move only
the keys that cross ``min_docs`` in the filters; deleting what was inserted
gives the former state again.  A shard that has no room left is rebuilt larger.

Edge cases: a null or empty text is one empty line; a null doc_id is one
document below all others; rows of equal doc_id are one document; lines repeated
within a document count once and stay or go together (ties); a very long text, or
line, is digested like any other; an empty table gives no row.  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut, stored, tidy

WHITE = b" \t\n\x0b\x0c\r"
FILTER_LIMIT = 64 << 20
SHARD_KEYS, COPIES = 1 << 16, 8
_NO_ID = -(1 << 63)


class Cuckoo:
    """Partial-key cuckoo filter: 4 slots of 16 bits a bucket, kept in one array."""

    SLOTS = 4

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / cls.SLOTS / 0.8))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = keys.astype(np.uint64)
        mark = ((k >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        mask = np.uint64(len(self.table) - 1)
        one = k & mask
        return mark, one.astype(np.int64), self._other(one, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        return ((at.astype(np.uint64) ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & mask).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def add(self, key: np.ndarray) -> bool:
        """False if no place was found; the filter must then be rebuilt at twice the size."""
        mark, one, two = self._places(key.reshape(1))
        mark, at = mark[0], int(one[0])
        for turn in range(500):
            for place in (at, int(two[0])) if turn == 0 else (at,):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = mark
                    return True
            slot = turn % self.SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = int(self._other(np.array([at]), np.array([mark]))[0])
        return False

    def remove(self, key: np.ndarray) -> None:
        mark, one, two = self._places(key.reshape(1))
        for place in (int(one[0]), int(two[0])):
            hit = np.flatnonzero(self.table[place] == mark[0])
            if len(hit):
                self.table[place, hit[0]] = 0
                return

    def add_all(self, keys: np.ndarray) -> bool:
        """Insert distinct keys: into free slots all at once, and what finds none one by one; False if some found no place."""
        mark, one, two = self._places(keys)
        left = np.arange(len(keys))
        for at in (one, two):
            for slot in range(self.SLOTS):
                free = left[self.table[at[left], slot] == 0]
                _, first = np.unique(at[free], return_index=True)
                now = free[first]
                self.table[at[now], slot] = mark[now]
                left = np.setdiff1d(left, now, assume_unique=True)
        return all(self.add(keys[i : i + 1]) for i in left)

    @classmethod
    def of(cls, keys: np.ndarray) -> Cuckoo:
        size = len(keys)
        while True:
            made = cls.sized(size)
            if made.add_all(keys):
                return made
            size *= 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    line = line.strip(WHITE)
    n = len(line)
    if n < min_chars or (n < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(line.lower(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    for x in batch.column(name).cast(pa.binary()):
        yield x.as_py() or b""


def postings(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(k1, k2, doc): one row for each distinct key of each row of ``docs``."""

    def emit(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), _texts(batch, "text"), strict=True):
                found = {k for line in set(text.split(b"\n")) if (k := line_key(line, min_chars))}
                ids.extend([doc] * len(found))
                keys.extend(found)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(ids, pa.int64())], ["k1", "k2", "doc"])

    return docs.select(_doc(docs), "text").mapInArrow(tidy(emit), "k1 long, k2 long, doc long")


def _doc(docs: DataFrame):
    return F.coalesce(docs["doc_id"], F.lit(_NO_ID)).cast("bigint").alias("doc")


def refcounts(posted: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, last_doc), exact; repeated rows of one document count once."""
    return posted.distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))


def inserted(posted: DataFrame, docs: DataFrame, min_chars: int = 20) -> DataFrame:
    return posted.unionByName(postings(docs, min_chars))


def deleted(posted: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return posted.join(doc_ids.select(_doc(doc_ids)).distinct(), "doc", "left_anti").select("k1", "k2", "doc")


def _shard(shards: int):
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int").alias("shard")


def build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): a cuckoo filter of about SHARD_KEYS keys each."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Cuckoo.of(np.sort(pdf["k1"].to_numpy(np.int64)).view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iat[0])], "filter": [made.dump()]})

    return repeated.select("k1", "k2", _shard(shards)).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int) -> DataFrame:
    """Filters of ``after`` from those of ``before``: keys that appear are inserted, keys that went are deleted."""
    on = ["k1", "k2"]
    changes = after.join(before, on, "left_anti").select(*on, F.lit(1).alias("sign")).unionByName(before.join(after, on, "left_anti").select(*on, F.lit(-1).alias("sign")))

    def move(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        """The new filter of a shard; null where it has no room."""
        if len(old) == 0 and len(change) == 0:
            return pd.DataFrame({"shard": [], "filter": []})
        shard = int((old if len(old) else change)["shard"].iat[0])
        made = Cuckoo.load(old["filter"].iat[0]) if len(old) else Cuckoo.sized(len(change))
        for k in change.loc[change["sign"] < 0, "k1"].to_numpy(np.int64).view(np.uint64):
            made.remove(k)
        for k in change.loc[change["sign"] > 0, "k1"].to_numpy(np.int64).view(np.uint64):
            if not made.add(k):
                return pd.DataFrame({"shard": [shard], "filter": [None]})
        return pd.DataFrame({"shard": [shard], "filter": [made.dump()]})

    dealt = changes.select("k1", "sign", _shard(shards)).groupBy("shard")
    moved = stored(filters.groupBy("shard").cogroup(dealt).applyInPandas(move, "shard int, filter binary"), "filters")
    full = moved.where(F.col("filter").isNull()).select("shard")
    rebuilt = build_filters(after.withColumn("own", _shard(shards)).join(full.withColumnRenamed("shard", "own"), "own", "left_semi"), shards)
    return moved.where(F.col("filter").isNotNull()).unionByName(rebuilt)


def _sharded_hits(keyed: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Of the rows (doc, key, k1, k2), those that the filter of their shard holds; a task has one filter at a time."""
    copies = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), "filter")
    rows = keyed.select(_shard(shards), F.pmod(F.xxhash64("doc"), F.lit(COPIES)).cast("int").alias("copy"), F.lit(1).alias("place"), "doc", "key", "k1")
    both = rows.withColumn("filter", F.lit(None).cast("binary")).unionByName(
        copies.select("shard", "copy", F.lit(0).alias("place"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("k1"), "filter")
    )

    def probe(batches):
        table, where = None, None
        for batch in batches:
            shard, place = batch.column("shard").to_numpy(), batch.column("place").to_numpy()
            k1 = batch.column("k1").fill_null(0).to_numpy().view(np.uint64)
            hit = np.zeros(batch.num_rows, bool)
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (place[1:] != place[:-1]) | (place[1:] == 0), True]) if batch.num_rows else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if place[a] == 0:
                    table, where = Cuckoo.load(batch.column("filter")[int(a)].as_py()), shard[a]
                elif where == shard[a]:
                    hit[a:b] = table.holds(k1[a:b])
            yield batch.select(["doc", "key"]).filter(pa.array(hit))

    dealt = both.repartition("shard", "copy").sortWithinPartitions("copy", "shard", "place")
    return dealt.select("shard", "place", "doc", "key", "k1", "filter").mapInArrow(tidy(probe), "doc long, key binary")


def _probe(docs: DataFrame, filters, shards: int, min_chars: int) -> DataFrame:
    """Each row with its line count; clean rows with their digest, others with their text and the keys that hit."""
    schema = "doc long, doc_id long, n_lines long, kept_sha256 string, text binary, keys array<binary>"

    def probe(batches):
        tables = {k: Cuckoo.load(v) for k, v in filters.value.items()} if filters is not None else None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in _texts(batch, "text"):
                lines = text.split(b"\n")
                keys = [k for line in set(lines) if (k := line_key(line, min_chars))]
                if tables is not None and keys:
                    k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                    shard, hit = k[:, 1] % shards, np.zeros(len(k), bool)
                    for s in np.unique(shard):
                        if (table := tables.get(int(s))) is not None:
                            own = shard == s
                            hit[own] = table.holds(k[own, 0].view(np.uint64))
                    keys = [x for x, h in zip(keys, hit, strict=True) if h]
                out[0].append(len(lines))
                out[1].append(None if keys else hashlib.sha256(text).hexdigest())
                out[2].append(text if keys else None)
                out[3].append(keys)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), *arrays], ["doc", "doc_id", "n_lines", "kept_sha256", "text", "keys"])

    return docs.select(_doc(docs), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(probe), schema)


def _finish(joined: DataFrame, min_chars: int, with_text: bool) -> DataFrame:
    def finish(batches):
        for batch in batches:
            rows = batch.to_pydict()
            dropped, digests, kept = [], [], []
            for text, sha, drop in zip(rows["text"], rows["kept_sha256"], rows["drop"], strict=True):
                if drop and text is not None:
                    gone = set(drop)
                    lines = text.split(b"\n")
                    stay = [x for x in lines if line_key(x, min_chars) not in gone]
                    dropped.append(len(lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    dropped.append(0)
                digests.append(sha or hashlib.sha256(text or b"").hexdigest())
                kept.append(text.decode("utf-8", "replace") if with_text and text is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
            )

    return joined.select("doc_id", "n_lines", "kept_sha256", "text", "drop").mapInArrow(tidy(finish), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, filter_limit: int = FILTER_LIMIT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text) for every row; kept_text is null where the text is unchanged."""
    spark = docs.sparkSession
    repeated = cut(refcounts(postings(docs, min_chars)).where(F.col("n_docs") >= min_docs))
    keys = repeated.count()
    shards = max(1, -(-keys // SHARD_KEYS))
    built = build_filters(repeated, shards)
    filters = None
    if keys * 5 <= filter_limit:  # at most 5 bytes a key at this load
        filters = spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in built.collect()})  # filter_limit bytes at most
    seen = stored(_probe(docs, filters, shards, min_chars), "lines")
    hits = seen.select("doc", F.explode("keys").alias("key")).distinct()
    if filters is None:
        hits = _sharded_hits(_halves(hits), stored(built, "filters"), shards)
    wire = F.unhex(F.concat(_little("k1"), _little("k2")))
    table = repeated.select(wire.alias("key"), "last_doc")
    drops = hits.join(table, "key").where(F.col("doc") < F.col("last_doc")).groupBy("doc").agg(F.collect_list("key").alias("drop"))
    return _finish(seen.drop("keys").join(drops, "doc", "left"), min_chars, with_text)


def _halves(hits: DataFrame) -> DataFrame:
    """(doc, key, k1, k2): the two longs of each key, as the digests are laid out."""

    def run(batches):
        for batch in batches:
            k = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(k[:, 0]), pa.array(k[:, 1])], ["doc", "key", "k1", "k2"])

    return hits.mapInArrow(tidy(run), "doc long, key binary, k1 long, k2 long")


def _little(name: str):
    """Hex digits of a long in little-endian byte order, as the digests are laid out."""
    h = F.lpad(F.hex(name), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])
