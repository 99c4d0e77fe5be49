"""Training-order materialisation of token ids.

Texts are tokenised by a public byte-level vocabulary and each is closed by one
end token.  In the order of a 64-bit hash of id and text all tokens form one
stream, which is cut into sequences of ``length`` ids (the last one padded).  A
keyed Feistel network with cycle-walking permutes 0..n-1: sequence i goes to slot
perm(i).  Slots are cut into ranges of ``stride`` records; a range is one shard of
fixed record size, so record r of shard s stands at byte ``r * record`` and
reading can resume anywhere.

Documents are dealt to ranges of the hash, as many as their bytes ask for.  The
number of ranges changes nothing in the result: a range knows how many tokens come
before it, and a sequence across a border is put together in its shard.  Shards are
dealt to tasks in ranges too.  Rows of one id and text are tokenised once a task
and travel as one row with a count.

Payloads move packed and compressed: twice through a shuffle (by hash range, by
shard range), once through a table in the shared folder.

Edge cases: a null text is empty and gives just the end token; rows with a null
id are ordered like others; repeated rows are kept each, next to one another; rows
of one hash are ordered by id, then by text (ties); white space of any length
within a very long text gets the ids that the vocabulary's pattern gives it; an
empty table gives no sequence.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import stored, tidy

LENGTH, STRIDE, KEY = 2048, 4096, 0x5EED
RANGE_BYTES, MOST_RANGES, MOST_TASKS = 64 << 20, 1 << 20, 20_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE, PIECE = 64 << 20, 1 << 20
RUN = 100_000
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@lru_cache(maxsize=2)
def encoding(lines: bytes):
    """Encoder and end id of a vocabulary file's content (a token and its rank a line)."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encode(enc, text: str) -> list[int]:
    """Ids of a text.  Long runs of white space, on which the pattern's look-ahead exhausts its stack, are cut out as the pattern cuts them: all but the last blank before a word."""
    if len(text) < RUN:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in BLANKS.finditer(text):
        a, b = run.span()
        b -= b < len(text)
        out += enc.encode_ordinary(text[at:a]) + enc._encode_single_piece(text[a:b])
        at = b
    return out + enc.encode_ordinary(text[at:])


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Keyed Feistel permutation of 0..n-1; values outside are walked on until they fall inside."""
    from ._text import U, mix

    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    out = np.array(index, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> U(half), x & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right + U(((key + 1) * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & (1 << 64) - 1)) & mask)
        out[todo] = (left << U(half)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any type, one after the other, compressed."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<8sQ", a.dtype.str.encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out, heads = 1, [], []
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<8sQ", raw, at)
        heads.append((np.dtype(kind.rstrip(b"\0").decode()), n))
        at += 16
    for dtype, n in heads:
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    return out


def _frame(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


NO_ID = -(1 << 63)


def _tokenise(docs: DataFrame, vocabulary: str, bits: int) -> DataFrame:
    """(g, payload): for each task and hash range, hashes, ids, tie-breaks, copies, token counts and tokens of its documents."""

    with open(vocabulary, "rb") as f:  # about a megabyte, read by the driver alone
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc, end = encoding(shared.value)
        dtype = np.uint16 if end < 1 << 16 else np.uint32
        held: dict[int, list] = {}
        known: dict[tuple, list] = {}
        size = 0

        def flush():
            for g, rows in sorted(held.items()):
                h, ids, ties, copies, toks = zip(*rows, strict=True)
                yield g, _pack(np.array(h, np.int64), np.array(ids, np.int64), np.array(ties, np.int64), np.array(copies, np.int64), np.array([len(t) for t in toks], np.int64), np.concatenate(toks))
            held.clear()
            known.clear()

        def batch_of(rows):
            return _frame(list(rows), ["g", "payload"], [pa.int32(), pa.binary()])

        for batch in batches:
            for doc, h, g, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "g", "text")), strict=True):
                text = text or ""
                tie = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                if (row := known.get((doc, tie))) is not None:
                    row[3] += 1
                    continue
                row = known[(doc, tie)] = [h, NO_ID if doc is None else doc, tie, 1, np.array([*encode(enc, text), end], dtype)]
                held.setdefault(g, []).append(row)
                size += row[4].nbytes + 64
                if size > SLICE:
                    yield batch_of(flush())
                    size = 0
        yield batch_of(flush())

    h = F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))
    g = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(NO_ID)), 64 - bits).cast("int") if bits else F.lit(0)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("h", h).select("doc_id", "h", g.alias("g"), "text")
    return source.mapInArrow(tidy(run), "g int, payload binary")


def _stream(packed: DataFrame) -> DataFrame:
    """(g, first, n, payload): each range's stream in pieces of about PIECE tokens: where documents begin, their ids, and the tokens."""

    def pieces(parts):
        h, ids, ties, copies, counts = (np.concatenate([p[k] for p in parts]) for k in range(5))
        at = np.concatenate([np.r_[0, np.cumsum(p[4])[:-1]] for p in parts])
        of = np.repeat(np.arange(len(parts)), [len(p[4]) for p in parts])
        first, begin, docs, toks, size = 0, [], [], [], 0
        for i in np.lexsort((ties, ids, h)).tolist():
            body = parts[of[i]][5][at[i] : at[i] + counts[i]]
            for _ in range(int(copies[i])):
                left = body
                while len(left):
                    begin.append(size)
                    docs.append(int(ids[i]))
                    toks.append(left[: PIECE - size])
                    size += len(toks[-1])
                    left = left[len(toks[-1]) :]
                    if size == PIECE:
                        yield first, size, _pack(np.array(begin, np.int64), np.array(docs, np.int64), np.concatenate(toks))
                        first, begin, docs, toks, size = first + size, [], [], [], 0
        if size:
            yield first, size, _pack(np.array(begin, np.int64), np.array(docs, np.int64), np.concatenate(toks))

    def run(batches):
        names, kinds = ["g", "first", "n", "payload"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        now, parts = None, []
        for batch in batches:
            for g, payload in zip(batch.column("g").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if g != now and parts:
                    for row in pieces(parts):
                        yield _frame([(now, *row)], names, kinds)
                    parts = []
                now = g
                parts.append(_unpack(payload))
        if parts:
            for row in pieces(parts):
                yield _frame([(now, *row)], names, kinds)

    return packed.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(run), "g int, first long, n long, payload binary")


def _cut(start: int, begin: np.ndarray, docs: np.ndarray, toks: np.ndarray, length: int):
    """Parts of sequences in a piece that starts at token ``start``: (sequence, offset in it, tokens, first and last document, token bounds)."""
    stop = start + len(toks)
    sequence = np.arange(start // length, -(-stop // length))
    a, b = np.maximum(sequence * length, start), np.minimum((sequence + 1) * length, stop)
    return sequence, a - sequence * length, b - a, docs[np.searchsorted(begin, a - start, "right") - 1], docs[np.searchsorted(begin, b - start - 1, "right") - 1], a - start


def ranges_for(docs: DataFrame, range_bytes: int) -> int:
    """Bits of the hash by which documents are dealt: ranges of about ``range_bytes`` of text."""
    total = docs.select(F.sum(F.octet_length("text").cast("bigint")), F.count(F.lit(1))).first()
    want = ((total[0] or 0) + 16 * total[1]) / range_bytes
    return int(np.ceil(np.log2(min(MOST_RANGES, max(1.0, want)))))


def materialise(docs: DataFrame, length: int = LENGTH, stride: int = STRIDE, key: int = KEY, vocabulary: str = VOCABULARY, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(slot, shard, record, sequence, n_tokens, first_doc, last_doc, tokens): every sequence once, in order of slots within a task."""
    spark = docs.sparkSession
    table = stored(_stream(_tokenise(docs, vocabulary, ranges_for(docs, range_bytes))), "stream")
    offsets, tokens = {}, 0
    for r in table.groupBy("g").agg(F.sum("n").alias("n")).orderBy("g").collect():  # one number a range
        offsets[r["g"]] = tokens
        tokens += r["n"]
    if not tokens:
        return spark.createDataFrame([], SEQUENCE_SCHEMA)
    total = -(-tokens // length)
    shards = -(-total // stride)
    shared = spark.sparkContext.broadcast(offsets)

    def route(batches):
        for batch in batches:
            for g, first, payload in zip(*(batch.column(c).to_pylist() for c in ("g", "first", "payload")), strict=True):
                begin, docs, toks = _unpack(payload)
                index, offset, size, one, two, at = _cut(shared.value[g] + first, begin, docs, toks, length)
                slot = permute(index, total, key)
                shard = slot // stride
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0, True])
                out = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    o = order[a:b]
                    out.append((int(shard[o[0]]), _pack(slot[o], index[o], offset[o], size[o], one[o], two[o], np.concatenate([toks[at[i] : at[i] + size[i]] for i in o]))))
                yield _frame(out, ["shard", "payload"], [pa.int64(), pa.binary()])

    def settle(batches):
        def emit(shard, parts):
            slot, index, offset, size, one, two = (np.concatenate([p[k] for p in parts]) for k in range(6))
            toks = np.concatenate([p[6] for p in parts])
            at = np.r_[0, np.cumsum(size)[:-1]]
            order = np.lexsort((offset, slot))
            cuts = np.flatnonzero(np.r_[True, np.diff(slot[order]) > 0, True])
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                body, o = np.zeros(length, toks.dtype), order[a:b]
                for i in o:
                    body[offset[i] : offset[i] + size[i]] = toks[at[i] : at[i] + size[i]]
                s = int(slot[o[0]])
                out.append((s, shard, s - shard * stride, int(index[o[0]]), int(size[o].sum()), _id(one[o[0]]), _id(two[o[-1]]), body.tobytes()))
                if len(out) == 512:
                    yield _frame(out, SEQUENCE_NAMES, SEQUENCE_KINDS)
                    out = []
            if out:
                yield _frame(out, SEQUENCE_NAMES, SEQUENCE_KINDS)

        now, parts = None, []
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if shard != now and parts:
                    yield from emit(now, parts)
                    parts = []
                now = shard
                parts.append(_unpack(payload))
        if parts:
            yield from emit(now, parts)

    routed = table.mapInArrow(tidy(route), "shard long, payload binary")
    # range partitions by the shard's number, which needs no sampling
    tasks = min(shards, MOST_TASKS)
    dealt = routed.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))
    return dealt.sortWithinPartitions("shard").mapInArrow(tidy(settle), SEQUENCE_SCHEMA)


SEQUENCE_SCHEMA = "slot long, shard long, record long, sequence long, n_tokens int, first_doc long, last_doc long, tokens binary"


SEQUENCE_NAMES = ["slot", "shard", "record", "sequence", "n_tokens", "first_doc", "last_doc", "tokens"]
SEQUENCE_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def _id(x: int) -> int | None:
    return None if x == NO_ID else int(x)


def digests(sequences: DataFrame) -> DataFrame:
    return sequences.withColumn("tokens_sha256", F.sha2("tokens", 256)).drop("tokens")


def write_shards(sequences: DataFrame, path: str) -> DataFrame:
    """Write ``shard-NNNNNNNN.bin`` files of fixed-size records; returns the manifest (shard, records, bytes, sha256).

    A file is written under a name of its attempt and moved into place, and its digest is
    put beside it last.  A shard is left alone only if that digest is the one of the
    records that belong there now, so a broken run is taken up where it stopped, a
    repeated task does no harm, and shards of another key, corpus or length are written
    anew.  ``path`` is any URI pyarrow opens; on a cluster it must be a folder that all
    executors share.  publish() then names what belongs to the run.
    """

    def run(batches):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root, recursive=True)

        def put(name: str, body: bytes) -> None:
            attempt = f"{name}.{uuid.uuid4().hex}"
            with where.open_output_stream(attempt) as f:
                f.write(body)
            where.move(attempt, name)

        def close(shard, parts):
            body = b"".join(parts)
            name, digest = f"{root}/shard-{shard:08d}.bin", hashlib.sha256(body).hexdigest()
            there, beside = where.get_file_info([name, f"{name}.sha256"])
            known = beside.type != fs.FileType.NotFound and where.open_input_stream(beside.path).readall().decode()
            if there.type == fs.FileType.NotFound or there.size != len(body) or known != digest:
                if beside.type != fs.FileType.NotFound:
                    where.delete_file(beside.path)  # it must not vouch for other records while they are replaced
                put(name, body)
                put(f"{name}.sha256", digest.encode())
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(parts)], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([digest], pa.string())], ["shard", "records", "bytes", "sha256"])

        now, parts = None, []
        for batch in batches:
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if shard != now and parts:
                    yield close(now, parts)
                    parts = []
                now = shard
                parts.append(tokens)
        if parts:
            yield close(now, parts)

    return sequences.select("shard", "tokens").mapInArrow(run, "shard long, records long, bytes long, sha256 string")


def publish(sequences: DataFrame, path: str) -> DataFrame:
    """write_shards(), with the manifest kept beside the shards and files of earlier runs that are not in it removed; returns the manifest."""
    from pyarrow import fs

    spark = sequences.sparkSession
    manifest = stored(write_shards(sequences, path), "manifest")
    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root, recursive=True)
    known = {f"shard-{r['shard']:08d}.bin" for r in manifest.select("shard").toLocalIterator()}  # a number a shard
    for info in where.get_file_info(fs.FileSelector(root)):
        if info.base_name.startswith("shard-") and info.base_name.removesuffix(".sha256") not in known:
            where.delete_file(info.path)
    manifest.orderBy("shard").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(manifest.schema).json(f"{path}/manifest")


def read_record(path: str, slot: int, length: int = LENGTH, stride: int = STRIDE, width: int = 2) -> np.ndarray:
    """One record by its slot, by a seek into its shard; ``path`` as for write_shards()."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path)
    size = length * width
    with where.open_input_file(f"{root}/shard-{slot // stride:08d}.bin") as f:
        f.seek(slot % stride * size)
        return np.frombuffer(f.read(size), np.uint16 if width == 2 else np.uint32)
