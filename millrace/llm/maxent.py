"""Language-model scoring by a hashed maximum-entropy model over class-factored words.

Tokens are words (A-Z lower-cased) and one end per text.  Unigram counts cover
all training texts; they are summed by word hash and stay a table, so the
vocabulary may grow with the corpus.

A word's probability is factored along a path of three choices of ``WAYS`` each
(class, sub-class, leaf) and its share of its leaf:

    P(w | history) = P(class | h) P(sub-class | class, h) P(leaf | sub-class, h) P(w | leaf)

Each choice is a softmax over the sum of a bias and of the weights of three
features of the history: the previous word, the word before it (a skip feature),
and both.  A feature's weights at a choice stand in one row of a hashed table
whose rows grow with the vocabulary.  So context decides within classes as well,
down to the leaf; frequent words have a leaf of their own, others share one by
relative frequency, and words outside the clustered ones are dealt by their
ending and their hash to the leaves of the last class, where each leaf keeps one
place for unseen words.

Leaves come from all training texts: the most frequent words are clustered by how
often they stand near the anchors, the very most frequent ones, and cut into
leaves of equal mass.

Training is ``rounds`` synchronous rounds, one for each hash shard of the training
texts.  A round sums both halves of the gradient, the observed and the expected
count of every weight, over its shard and makes one step on the driver, scaled
by their ratio (iterative scaling).  Shares of expected counts are rounded to whole
parts of SCALE, up or down by a hash of where the token stands, so they are right on
average and their sums exact: the weights, and all scores, are the same however the
rows are dealt to tasks.

Texts are read twice, for counts and to encode them; what follows reads the
encoded table.  Only tables of fixed or bounded size are broadcast: ``head``
words, and at most 2**17 rows of weights.  The counts of the other words reach the
texts by a join on the word.

Edge cases: a null or empty text is one end; without training texts every word
is unseen; repeated rows, and rows without an id, are scored each; words of one
count go into the head together or not at all (ties); a very long text is encoded
in slices of bounded size and scored some tokens at a time.  Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _sketch
from ._session import discard, stored, tidy
from ._text import LOWER, U, binaries, chunks, hashes, mix, spans
from .langid import held_out

HEAD, CLUSTERED, ANCHORS, CLUSTERS, ROUNDS = 1 << 18, 1 << 14, 64, 8, 4
WAYS = 16
LEAVES = WAYS**3
TAIL = LEAVES - WAYS * WAYS  # first leaf of the last class
NODES = 1 + WAYS + WAYS * WAYS
END, START = U(0), 1 << 40  # no word hashes to END by more than chance
SCALE, STEP, DECAY, SMOOTH, MOST = 1 << 9, 0.5, 0.8, 2.0, 20.0
TOKENS, BLOCK = 1 << 16, 1 << 13
PACK = 26  # bits of a sum: two sums share a float's 53
CHUNK = 1 << 17


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each row, bounds of the rows); the lowest four bits of a hash tell a word's ending."""
    starts, ends, rows = spans(raw, offsets)
    w = hashes(raw, starts, ends)
    if len(w):
        last = LOWER[raw[ends - 1]].astype(np.uint64) * U(256) + np.where(ends - starts > 1, LOWER[raw[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
        w = (w & ~U(WAYS - 1)) | (mix(last + U(1)) & U(WAYS - 1))
    n = len(offsets) - 1
    size = np.bincount(rows, minlength=n) + 1
    bounds = np.r_[0, np.cumsum(size)]
    out = np.full(bounds[-1], END)
    out[np.arange(len(w)) + rows] = w
    return out, bounds


def _counts(train: DataFrame) -> DataFrame:
    """(h, c): occurrences of each word hash, ends included; summed within a task first."""

    def run(batches):
        held, size = [], 0

        def flush():
            h = np.concatenate(held)
            h.sort()
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(h)]))], ["h", "c"])

        for batch in batches:
            for _, raw, offsets in chunks(batch.column("text")):
                t, _ = tokens(raw, offsets)
                held.append(t)
                size += len(t)
                if size > 6_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return train.select("text").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _head(counts: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, counts, least count) of the words above the least count that no more than ``head`` words reach.

    The least count comes from a histogram of counts, exact up to 4096 and by powers of 2**(1/16) beyond.
    """
    level = F.when(F.col("c") <= 4096, F.col("c")).otherwise(4096 + F.ceil(F.log2(F.col("c") / 4096) * 16)).cast("long")
    hist = sorted((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, total = 1 << 62, 0
    for value, n in reversed(hist):
        total += n
        if total > head:
            break
        least = value if value <= 4096 else int(np.floor(4096 * 2.0 ** ((value - 4097) / 16))) + 1
    top = counts.where(F.col("c") >= least).toArrow()
    words, count = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(words)
    return words[order], count[order], least


@dataclass
class Model:
    """Everything of bounded size that encoding and scoring need."""

    words: np.ndarray  # sorted hashes of the head
    count: np.ndarray
    leaf: np.ndarray  # leaf of each head word
    inside: np.ndarray  # log10 P(word | leaf) of each head word
    rest: np.ndarray  # log10 of the total of each leaf of the last class
    bias: np.ndarray  # (NODES, WAYS)
    weights: np.ndarray  # (rows, WAYS), rows a power of two


def _codes(words: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Place in the head, or -1 - 30 bits of the hash for any other word."""
    other = -1 - (t & U((1 << 30) - 1)).astype(np.int64)
    if not len(words):
        return other.astype(np.int32)
    at = np.minimum(np.searchsorted(words, t), len(words) - 1)
    return np.where(words[at] == t, at, other).astype(np.int32)


def _tail_leaf(x: np.ndarray) -> np.ndarray:
    """Leaf of a word outside the clustered ones, from its hash's lowest bits: its ending, then its hash."""
    return TAIL + ((x & (WAYS - 1)) * WAYS) + ((x // WAYS) & (WAYS - 1))


def leaves(model: Model, codes: np.ndarray) -> np.ndarray:
    other = _tail_leaf(-1 - codes.astype(np.int64))
    return np.where(codes >= 0, model.leaf[np.maximum(codes, 0)], other) if len(model.leaf) else other


def _anchors(count: np.ndarray) -> np.ndarray:
    """Places of the most frequent head words."""
    return np.argsort(-count, kind="stable")[:ANCHORS]


def _slots(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(clustered places, row of each head word among them or -1, column of each anchor or -1)."""
    some = np.argsort(-count, kind="stable")[:CLUSTERED]
    row, column = np.full(len(count), -1), np.full(len(count), -1)
    row[some] = np.arange(len(some))
    anchors = _anchors(count)
    column[anchors] = np.arange(len(anchors))
    return some, row, column


def _encoded(source: DataFrame, words: np.ndarray, count: np.ndarray) -> DataFrame:
    """A row for each text (its codes, and the hashes of its words outside the head); at the end of a task, how often clustered words stand near anchors in its training texts."""
    _, row_of, column_of = _slots(count)
    shared = source.sparkSession.sparkContext.broadcast((words, row_of, column_of))
    width = min(ANCHORS, len(count))
    size = min(CLUSTERED, len(count)) * width
    names = ["doc_id", "shard", "n_tokens", "codes", "tail", "chunk", "counts"]

    def run(batches):
        words, row_of, column_of = shared.value
        near, keys, waiting = np.zeros(size, np.int32), [], 0

        def settle():
            if keys:
                near[:] += np.bincount(np.concatenate(keys), minlength=size).astype(np.int32)
                keys.clear()

        for batch in batches:
            ids, shard = batch.column("doc_id"), batch.column("shard")
            for a, raw, offsets in chunks(batch.column("text")):
                t, bounds = tokens(raw, offsets)
                n = len(bounds) - 1
                codes = _codes(words, t)
                if size:
                    use = (shard.slice(a, n).to_numpy() >= 0).repeat(np.diff(bounds))
                    row = np.repeat(np.arange(n), np.diff(bounds))
                    at = np.maximum(codes, 0)
                    r, c = np.where((codes >= 0) & use, row_of[at], -1), np.where((codes >= 0) & use, column_of[at], -1)
                    for gap in (1, 2):
                        same = row[:-gap] == row[gap:]
                        for x, y in ((r[:-gap], c[gap:]), (r[gap:], c[:-gap])):
                            hit = same & (x >= 0) & (y >= 0)
                            keys.append(x[hit] * width + y[hit])
                            waiting += len(keys[-1])
                    if waiting > 4_000_000:
                        settle()
                        waiting = 0
                tail = np.flatnonzero(codes < 0)
                tails = np.searchsorted(tail, bounds)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, n), shard.slice(a, n), pa.array(np.diff(bounds).astype(np.int64)), binaries(bounds, codes), binaries(tails, t[tail]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
                )
        settle()
        rows = list(_sketch.chunk_rows(near, CHUNK)) if size else []
        m = len(rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array([-2] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

    return source.mapInArrow(tidy(run), "doc_id long, shard int, n_tokens long, codes binary, tail binary, chunk int, counts binary")


def _clusters(near: np.ndarray, count: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Cluster of each row by the anchors beside it (spherical k-means, centres started farthest-first over the anchors' rows)."""
    scaled = np.sqrt(near.astype(np.float32))
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
    centre = [scaled[anchors[0]]]
    for _ in range(CLUSTERS - 1):
        far = np.max(np.stack([scaled[anchors] @ c for c in centre]), axis=0)
        centre.append(scaled[anchors[int(far.argmin())]])
    centre = np.stack(centre)
    for _ in range(12):
        own = (scaled @ centre.T).argmax(axis=1)
        for k in range(CLUSTERS):
            part = (scaled[own == k] * np.log1p(count[own == k])[:, None]).sum(axis=0) if (own == k).any() else centre[k]
            centre[k] = part / max(1e-9, float(np.linalg.norm(part)))
    return np.where(near.sum(axis=1) > 0, (scaled @ centre.T).argmax(axis=1), 0)


def _model(words: np.ndarray, count: np.ndarray, near: np.ndarray, rest: np.ndarray, rows: int) -> Model:
    """Leaves, shares and biases; ``rest`` has the totals (occurrences and kinds) of the words outside the head by leaf of the last class."""
    leaf = _tail_leaf((words & U((1 << 30) - 1)).astype(np.int64))
    some = _slots(count)[0]
    if len(some):
        order = np.lexsort((some, -count[some], _clusters(near, count[some], np.arange(min(ANCHORS, len(some))))))
        mass = np.cumsum(np.sqrt(count[some][order]))
        leaf[some[order]] = np.minimum(TAIL - 1, (mass - np.sqrt(count[some][order]) / 2) * TAIL / mass[-1]).astype(np.int64)
    total = np.bincount(leaf, count, LEAVES).astype(float)
    total[TAIL:] += np.bincount(leaf, minlength=LEAVES)[TAIL:] + rest + 1.0
    inside = np.log10((count + (leaf >= TAIL)) / total[leaf])
    levels = [total.reshape(WAYS, -1).sum(axis=1)[None, :], total.reshape(WAYS, WAYS, WAYS).sum(axis=2), total.reshape(-1, WAYS)]
    bias = np.concatenate([np.log(np.maximum(x, 1e-12)) for x in levels])
    return Model(words, count, leaf, inside, np.log10(total[TAIL:]), (bias - bias.max(axis=1, keepdims=True)).clip(-30).astype(np.float32), np.zeros((rows, WAYS), np.float32))


def history(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(3, tokens): hashes of the previous word, the one before it, and both."""
    c = codes.astype(np.int64)
    place = np.arange(len(c)) - np.repeat(bounds[:-1], np.diff(bounds))
    one = np.where(place >= 1, np.r_[START, c[:-1]], START).view(np.uint64)
    two = np.where(place >= 2, np.r_[START, START, c[:-2]][: len(c)], START).view(np.uint64)
    x, y = mix(one * U(0x9E3779B97F4A7C15) + U(11)), mix(two * U(0x9E3779B97F4A7C15) + U(13))
    return np.stack([x, y, mix(x * U(3) + y)])


def _choices(model: Model, feats: np.ndarray, leaf: np.ndarray):
    """For each of the three choices of some tokens at a time: (first token, number of the choice, rows of the weights, exponentials of the ways, their sum, log probability of the way taken, that way).

    The arrays of exponentials are used again for the next choice.  A node's largest
    bias is 0 and weights stay within MOST, so exponentials need no shift.
    """
    shift = U(64 - (len(model.weights).bit_length() - 1))
    z, part = np.empty((BLOCK, WAYS), np.float32), np.empty((BLOCK, WAYS), np.float32)
    for a in range(0, len(leaf), BLOCK):
        own, f = leaf[a : a + BLOCK], feats[:, a : a + BLOCK]
        n = len(own)
        for c, (node, way) in enumerate(((np.zeros_like(own), own // WAYS**2), (1 + own // WAYS**2, own // WAYS % WAYS), (1 + WAYS + own // WAYS, own % WAYS))):
            rows = (((f + node.astype(np.uint64) * U(0xD6E8FEB86659FD93)) * U(0x9FB21C651E98DF25)) >> shift).astype(np.int64)
            np.take(model.bias, node, axis=0, out=z[:n], mode="clip")
            for r in rows:
                z[:n] += np.take(model.weights, r, axis=0, out=part[:n], mode="clip")
            taken = z[np.arange(n), way]
            total = np.exp(z[:n], out=part[:n]).sum(axis=1)
            yield a, c, rows, part[:n], total, taken - np.log(total), way


def _texts(batch: pa.RecordBatch):
    """Codes of some texts at a time: (first row, codes, bounds), of about TOKENS tokens or one text."""
    col = batch.column("codes")
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    codes = np.frombuffer(col.buffers()[2], np.int32) if offs[-1] else np.zeros(0, np.int32)
    offs //= 4
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + TOKENS, "right")) - 1)
        yield at, codes[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def _tallied(model: Model, codes: np.ndarray, bounds: np.ndarray, expected: np.ndarray, observed: np.ndarray) -> None:
    """Add up what every weight meets in some texts: expected counts in parts of SCALE, and observed ones."""
    rows = len(model.weights)
    leaf, feats = leaves(model, codes), history(codes, bounds)
    place = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
    up = ((mix(feats[2] + place.astype(np.uint64)) >> U(40)).astype(np.float32) * np.float32(2.0**-24))[:, None]
    for a in range(0, len(codes), TOKENS):
        n = min(TOKENS, len(codes) - a)
        where, pairs, ways = np.empty((3, 3, n), np.int64), np.empty((3, WAYS // 2, n)), np.empty((3, n), np.int64)
        for at, c, r, e, total, _, way in _choices(model, feats[:, a : a + n], leaf[a : a + n]):
            to = slice(at, at + len(way))
            share = np.floor(e * (np.float32(SCALE) / total)[:, None] + up[a : a + n][to]).astype(np.float64)
            where[c, :, to], ways[c, to] = r, way
            pairs[c, :, to] = share[:, : WAYS // 2].T * float(1 << PACK) + share[:, WAYS // 2 :].T
        for c in range(3):
            flat = where[c].ravel()
            for k in range(WAYS // 2):
                both = np.bincount(flat, np.tile(pairs[c, k], 3), rows).astype(np.int64)
                expected[k] += both >> PACK
                expected[k + WAYS // 2] += both & ((1 << PACK) - 1)
        observed += np.bincount((where * WAYS + ways[:, None, :]).ravel(), minlength=rows * WAYS)


def _ratios(sums: DataFrame) -> DataFrame:
    """(chunk, ratios): of chunks that hold as many expected counts, in parts of SCALE, as observed ones after them, the logarithm of what was observed over what was expected."""

    def run(batches):
        for batch in batches:
            both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array([np.log((observed + SMOOTH) / (expected / SCALE + SMOOTH)).tobytes() for expected, observed in both], pa.binary())], ["chunk", "ratios"])

    return sums.mapInArrow(tidy(run), "chunk int, ratios binary")


def _step(model: Model, shard: DataFrame, step: float = STEP) -> np.ndarray:
    """Weights after one round over a shard; the tasks that sum the counts make them one ratio a weight, which is all the driver gets."""
    shared = shard.sparkSession.sparkContext.broadcast(model)
    rows = len(model.weights)
    half = min(CHUNK // 2, rows * WAYS)

    def run(batches):
        expected, observed = np.zeros((WAYS, rows), np.int64), np.zeros(rows * WAYS, np.int64)
        for batch in batches:
            for _, codes, bounds in _texts(batch):
                _tallied(shared.value, codes, bounds, expected, observed)
        both = np.stack([expected.T.reshape(-1, half), observed.reshape(-1, half)], axis=1)
        yield _sketch.batch_of(_sketch.chunk_rows(both.ravel(), 2 * half))

    weights = model.weights.flatten()
    for r in _ratios(_sketch.summed(shard.select("codes").mapInArrow(tidy(run), "chunk int, counts binary"), "int64")).collect():
        part = weights[r["chunk"] * half : (r["chunk"] + 1) * half]
        part[:] = np.clip(part + step * np.frombuffer(r["ratios"], np.float64), -MOST, MOST)
    shared.destroy()
    return weights.reshape(rows, WAYS)


def _scored(table: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, base, score): what the bounded tables give of each text."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score"]

    def run(batches):
        model = shared.value
        for batch in batches:
            for at, codes, bounds in _texts(batch):
                leaf, logp = leaves(model, codes), np.zeros(len(codes))
                for a, _, _, _, _, taken, _ in _choices(model, history(codes, bounds), leaf):
                    logp[a : a + len(taken)] += taken
                logp /= np.log(10.0)
                known, spot = codes >= 0, np.maximum(codes, 0)
                logp += np.where(known, model.inside[spot], 0.0) if len(model.inside) else 0.0
                logp -= np.where(known, 0.0, model.rest[np.maximum(leaf - TAIL, 0)])
                seen = np.where(known, np.log10(model.count[spot] + 1.0), 0.0) if len(model.count) else np.zeros(len(codes))
                n = len(bounds) - 1
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (known.astype(np.int64), seen, logp)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, n) for c in names[:3]], *[pa.array(x) for x in sums]], names)

    return table.select("row", "doc_id", "n_tokens", "codes").mapInArrow(tidy(run), "row long, doc_id long, n_tokens long, n_known long, base double, score double")


def _tails(table: DataFrame) -> DataFrame:
    """(row, h, k): how often each word outside the head stands in each text."""

    def run(batches):
        for batch in batches:
            col = batch.column("tail")
            offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) // 8
            words = np.frombuffer(col.buffers()[2], np.int64)[offs[0] : offs[-1]] if offs[-1] else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(col)), np.diff(offs))
            order = np.lexsort((words, row))
            words, row = words[order], row[order]
            first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (row[1:] != row[:-1])]) if len(words) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row[first])), pa.array(words[first]), pa.array(np.diff(np.r_[first, len(words)]))], ["row", "h", "k"])

    return table.select("row", "tail").mapInArrow(tidy(run), "row long, h long, k long")


def table_rows(kinds: int) -> int:
    """Rows of the weight table for a vocabulary of ``kinds`` words: as many, a power of two, from 2**14 up to 2**17."""
    return 1 << int(np.clip(np.ceil(np.log2(max(1, kinds))), 14, 17))


def score(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS, mod: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    out = held_out(F.col("doc_id"), mod, rest)
    shard = F.when(out, -1).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))).cast("int").alias("shard")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", shard)
    counts = stored(_counts(source.where("shard >= 0")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words, count, least = _head(counts, head)
    table = stored(_encoded(source, words, count).withColumn("row", F.monotonically_increasing_id()), "tokens", by="shard")
    clustered, anchors = min(CLUSTERED, len(words)), min(ANCHORS, len(words))
    near = _sketch.add_up(table.where("shard = -2").select("chunk", "counts"), "int32", clustered * anchors, CHUNK).reshape(clustered, anchors)
    others = counts.where(F.col("c") < least)
    ending, below = F.col("h").bitwiseAND(WAYS - 1), F.shiftrightunsigned("h", 4).bitwiseAND(WAYS - 1)
    left = np.zeros(WAYS * WAYS)
    for r in others.groupBy((ending * WAYS + below).cast("int").alias("leaf")).agg((F.sum("c") + F.count(F.lit(1))).alias("total")).collect():
        left[r["leaf"]] = r["total"]
    model = _model(words, count, near, left, table_rows(int(v)))
    for r in range(rounds):
        model.weights = _step(model, table.where(F.col("shard") == r), STEP * DECAY**r)
    texts = table.where("shard > -2")
    known = stored(_scored(texts, model), "scores")
    # sums of whole numbers, so that they do not depend on the order of rows
    logs = F.round(F.log10(F.col("c") + 1) * float(1 << 32)).cast("long")
    sums = _tails(texts).join(others, "h").groupBy("row").agg(F.sum("k").alias("known"), (F.sum((F.col("k") * logs).cast("decimal(38,0)")) / float(1 << 32)).cast("double").alias("logs"))
    found = stored(known.join(sums, "row", "left"), "sums")
    discard(table, known, counts)
    extra = F.coalesce("logs", F.lit(0.0))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), mod, rest).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.log10(F.lit(float(n + (v + 1))))).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )
