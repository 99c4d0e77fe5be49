"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear SVM.

The kernel counts common subsequences of 3 and 4 symbols that span at most
``SPAN`` positions, each occurrence weighted by ``DECAY ** span``, so inserted or
missing letters only lower a similarity.  Subsequences are hashed into 2**17
dimensions, and the kernel is divided by sqrt(K(x, x) K(y, y)).  A string's
features are its kernel values to landmark strings, whitened by the landmarks' own
kernel matrix (Nystroem).  As kernel values are linear in the subsequence counts,
landmarks and SVM weights fold into one table over subsequences, and scoring a
string is a sum over that table with the same value.

Strings are the words of a text: characters that are neither letters nor digits
are left out of a word, every letter and digit of any script is a symbol of its
own, and runs of three or more one-letter words are joined to one word more.  Words
longer than a window are read in overlapping windows.  A text scores as its
highest word, mapped to 0..1 by a fitted logistic curve.

The SVM learns from a bounded sample of labelled training texts (``per_class``
toxic documents and twice as many clean ones, whole), as multiple instances: a
toxic text has at least one toxic word, a clean text none.

Edge cases: null and empty texts score as having no words; a document labelled
twice counts as toxic if any label says so, and so does a text that stands under
several ids; labels without an id or a value are passed over; without labels of
both kinds, or without a word that tells them apart, every score is the share of
toxic labels (0 without labels); repeated rows are scored each; ties in the hash
that samples are broken by id; a very long text is learned and scored a slice of
documents at a time, and alone where it outgrows one; an empty table gives no row.
Columns other than doc_id and text (doc_id and toxic) are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import tidy
from .langid import held_out

WINDOW, STRIDE, SPAN, DECAY, DIM = 15, 7, 6, 0.7, 1 << 17
SLICE = 1 << 20
MARK = 0x110010  # a word's beginning
_tables: dict[str, np.ndarray] = {}


def _plan() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (4 columns; -1: none) of each subsequence in a window, its weight, and its last position."""
    if "at" not in _tables:
        rows = [(*c, -1) if len(c) == 3 else c for p in (3, 4) for c in combinations(range(WINDOW), p) if c[-1] - c[0] < SPAN]
        at = np.array(rows)
        last = at.max(axis=1)
        _tables.update(at=at, weight=(DECAY ** (last - at[:, 0] + 1.0)).astype(np.float32), last=last)
    return _tables["at"], _tables["weight"], _tables["last"]


def _codes() -> np.ndarray:
    """Symbol of each code point: 0 leave out, 1 separator, and one of its own for every letter and digit."""
    if "codes" not in _tables:
        kind = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            kind[i] = 1 if c.isspace() else i + 2 if c.isalnum() else 0
        _tables["codes"] = kind
    return _tables["codes"]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, documents): symbols of every word window, 0-padded, and the text each stands in."""
    low = [t.lower() for t in texts]
    code = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _codes()[np.minimum(code, 0x10FFFF)]
    ends = np.cumsum([len(t) + 1 for t in low])
    used = np.flatnonzero(sym)
    s = sym[used]
    gap = np.flatnonzero(s == 1)
    if not len(gap):
        return np.zeros((0, WINDOW), np.uint32), np.zeros(0, np.int64)
    begin = np.r_[0, gap[:-1] + 1]
    keep = gap > begin
    begin, end = begin[keep], gap[keep]
    if not len(begin):
        return np.zeros((0, WINDOW), np.uint32), np.zeros(0, np.int64)
    doc = np.searchsorted(ends, used[begin], "right")
    flat_at = begin
    # runs of at least three one-letter words are one word more
    one = (end - begin) == 1
    change = np.flatnonzero(np.diff(np.r_[False, one, False].astype(np.int8)))
    a, b = change[::2], change[1::2]
    extra, extra_doc = [], []
    for x, y in zip(a, b, strict=True):
        while y - x >= 3:
            d = doc[x]
            z = x
            while z < y and doc[z] == d:
                z += 1
            if z - x >= 3:
                extra.append(s[begin[x:z]])
                extra_doc.append(d)
            x = z
    size = end - begin
    pieces_at, pieces_n, pieces_doc, pieces_first = [flat_at], [np.minimum(size, WINDOW - 1)], [doc], [np.ones(len(size), bool)]
    more = np.flatnonzero(size > WINDOW - 1)
    skip = STRIDE
    while len(more):
        pieces_at.append(flat_at[more] + skip)
        pieces_n.append(np.minimum(size[more] - skip, WINDOW))
        pieces_doc.append(doc[more])
        pieces_first.append(np.zeros(len(more), bool))
        more = more[size[more] - skip > WINDOW]
        skip += STRIDE
    at, n, doc, first = (np.concatenate(x) for x in (pieces_at, pieces_n, pieces_doc, pieces_first))
    out = np.zeros((len(at), WINDOW), np.uint32)
    shift = first.astype(np.int64)  # a whole word's window begins with a start mark
    for j in range(WINDOW):
        col = j - shift
        inside = (col >= 0) & (col < n)
        out[inside, j] = s[at[inside] + col[inside]]
    out[first, 0] = MARK
    if extra:
        more_rows = np.zeros((sum(max(1, -(-(len(e) + 1) // STRIDE)) for e in extra), WINDOW), np.uint32)
        more_doc, r = [], 0
        for e, d in zip(extra, extra_doc, strict=True):
            e = np.r_[np.uint32(MARK), e]
            for k in range(0, max(1, len(e)), STRIDE):
                part = e[k : k + WINDOW]
                more_rows[r, : len(part)] = part
                more_doc.append(d)
                r += 1
        out, doc = np.concatenate([out, more_rows[:r]]), np.concatenate([doc, more_doc])
    return out, doc


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, their 64-bit keys, place of each row among them)."""
    key = np.zeros(len(rows), np.uint64)
    for j in range(WINDOW):
        key = (key ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    keys, first, place = np.unique(key, return_index=True, return_inverse=True)
    return rows[first], keys, place


def subsequences(rows: np.ndarray) -> np.ndarray:
    """Hashed dimension of each planned subsequence of each window; DIM where it leaves the string."""
    at, _, last = _plan()
    x = rows.astype(np.uint32)
    n = (rows != 0).sum(axis=1)
    out = np.empty((len(rows), len(at)), np.int32)
    for q, (a, b, c, d) in enumerate(at):
        h = (x[:, a] * np.uint32(0x9E3779B1)) ^ (x[:, b] * np.uint32(0x85EBCA77)) ^ (x[:, c] * np.uint32(0xC2B2AE3D))
        if d >= 0:
            h = h ^ (x[:, d] * np.uint32(0x27D4EB2F)) ^ np.uint32(0x165667B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:, q] = np.where(last[q] < n, h >> np.uint32(15), DIM)
    return out


def norms(rows: np.ndarray, index: np.ndarray | None = None) -> np.ndarray:
    """sqrt(K(x, x)) of each string, from its subsequences' dimensions: weights that fall on one dimension add up before they are squared."""
    _, weight, last = _plan()
    n = (rows != 0).sum(axis=1)
    plain = np.array([(weight[last < k] ** 2).sum() for k in range(WINDOW + 1)])[n]
    # only strings with a repeated symbol have a subsequence twice (but for hashing, which is left to them too)
    symbols = np.sort(rows, axis=1)
    twice = np.flatnonzero(((symbols[:, 1:] == symbols[:, :-1]) & (symbols[:, 1:] != 0)).any(axis=1))
    for a in range(0, len(twice), 4096):
        own = twice[a : a + 4096]
        dims = subsequences(rows[own]) if index is None else index[own]
        order = np.argsort(dims, axis=1, kind="stable")
        d, w = np.take_along_axis(dims, order, axis=1), weight[order]
        first = np.ones(d.shape, bool)
        first[:, 1:] = d[:, 1:] != d[:, :-1]
        sums = np.add.reduceat(w.ravel(), np.flatnonzero(first.ravel()))
        squares = np.where(d.ravel()[first.ravel()] == DIM, 0.0, sums.astype(np.float64) ** 2)
        plain[own] = np.add.reduceat(squares, np.r_[0, np.cumsum(first.sum(axis=1))[:-1]])
    return np.sqrt(np.where(plain > 0, plain, 1.0)).astype(np.float32)


def dense(rows: np.ndarray) -> np.ndarray:
    """Each string's normalised subsequence counts over all dimensions (for landmarks only)."""
    _, weight, _ = _plan()
    out = np.zeros((len(rows), DIM + 1), np.float32)
    for i, idx in enumerate(subsequences(rows)):
        np.add.at(out[i], idx, weight)
    out[:, DIM] = 0
    return out / norms(rows)[:, None]


@dataclass
class Model:
    fold: np.ndarray  # weight of each subsequence dimension
    bias: float
    slope: float
    shift: float
    base: float

    def rate(self, rows: np.ndarray) -> np.ndarray:
        """SVM margin of each string."""
        _, weight, _ = _plan()
        out = np.empty(len(rows), np.float32)
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            index = subsequences(part)
            out[a : a + 4096] = self.fold[index] @ weight / norms(part, index)
        return out + np.float32(self.bias)

    def score(self, texts: list[str], known: dict | None = None) -> np.ndarray:
        if not self.slope:
            return np.full(len(texts), self.base)
        rows, doc = words(texts)
        best = np.full(len(texts), -2.0)
        if len(rows):
            rows, keys, place = distinct(rows)
            margin = np.empty(len(rows), np.float32)
            new = np.ones(len(rows), bool)
            if known is not None and len(known.get("keys", ())):
                spot = np.minimum(np.searchsorted(known["keys"], keys), len(known["keys"]) - 1)
                new = known["keys"][spot] != keys
                margin[~new] = known["margin"][spot[~new]]
            margin[new] = self.rate(rows[new])
            if known is not None:
                _remember(known, keys[new], margin[new])
            np.maximum.at(best, doc, margin[place])
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30)))


def _remember(known: dict, keys: np.ndarray, margin: np.ndarray, limit: int = 1 << 20) -> None:
    """Margins of words already rated by this task; started afresh beyond ``limit`` words."""
    if len(known.get("keys", ())) + len(keys) > limit:
        known.clear()
    have = known.get("keys", np.zeros(0, np.uint64))
    both, m = np.concatenate([have, keys]), np.concatenate([known.get("margin", np.zeros(0, np.float32)), margin])
    order = np.argsort(both, kind="stable")
    known["keys"], known["margin"] = both[order], m[order]


def _incidence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words of all texts, text and word of each occurrence, once a text); read in slices, so only distinct words are held."""
    parts, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        rows, doc = words(texts[at:to])
        if len(rows):
            rows, keys, place = distinct(rows)
            pair = np.unique(doc.astype(np.int64) * len(rows) + place)
            parts.append((rows, keys, pair // len(rows) + at, keys[pair % len(rows)]))
        at = to
    if not parts:
        return np.zeros((0, WINDOW), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, first = np.unique(np.concatenate([p[1] for p in parts]), return_index=True)
    rows = np.concatenate([p[0] for p in parts])[first]
    doc, of = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    return rows, doc, np.searchsorted(keys, of)


def learn(texts: list[str], toxic: np.ndarray, landmarks: int = 96, rounds: int = 4, seed: int = 11) -> Model:
    """Multiple-instance SVM over words: witnesses of toxic texts against the worst words of clean ones."""
    base = float(toxic.mean()) if len(toxic) else 0.0
    flat = Model(np.zeros(DIM + 1, np.float32), 0.0, 0.0, 0.0, base)
    if not len(texts) or toxic.all() or not toxic.any():
        return flat
    rng = np.random.default_rng(seed)
    rows, doc, place = _incidence(texts)
    if not len(rows):
        return flat
    bad = toxic[doc].astype(bool)
    t = np.bincount(place[bad], minlength=len(rows)).astype(float)
    f = np.bincount(place[~bad], minlength=len(rows)).astype(float)
    rate_t, rate_f = (t + 0.02) / (toxic.sum() + 1), (f + 0.5) / ((1 - toxic).sum() + 1)
    evidence = np.where(f <= 0.02 * t, t * np.log(rate_t / rate_f), -1.0)
    seeds = np.flatnonzero((evidence > 12) & (t >= 6))
    if not len(seeds):
        seeds = np.argsort(-(rate_t - rate_f))[:8]
    margin = np.full(len(rows), -1.0)
    margin[seeds] = 1.0 + evidence[seeds] / max(1.0, evidence[seeds].max())
    order = np.argsort(doc, kind="stable")
    doc, place = doc[order], place[order]
    bounds = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    of = doc[bounds]
    model = flat
    for turn in range(rounds):
        positive, negative = [], [rng.choice(np.flatnonzero((f > 0) | (t == 0)), size=min(4000, int(((f > 0) | (t == 0)).sum())), replace=False)]
        for j, a in enumerate(bounds):
            own = place[a : bounds[j + 1] if j + 1 < len(bounds) else len(place)]
            m = margin[own]
            if toxic[of[j]]:
                w = own[m.argmax()]
                if margin[w] > (0.0 if turn else 0.5):
                    positive.append(w)
            else:
                negative.append(own[np.argsort(-m)[:4]])
        pos_words, pos_n = np.unique(np.array(positive, int), return_counts=True)
        neg = np.unique(np.concatenate(negative))
        neg = neg[~np.isin(neg, pos_words) | (f[neg] > 0)]
        pos_words, pos_n = pos_words[~np.isin(pos_words, neg)], pos_n[~np.isin(pos_words, neg)]
        if not len(pos_words) or not len(neg):
            break
        strongest = pos_words[np.argsort(-pos_n)]
        hard = neg[np.argsort(-margin[neg], kind="stable")]
        marks = np.unique(np.concatenate([strongest[: landmarks * 2 // 3], hard[: landmarks // 3]]))
        feats = dense(rows[marks])
        gram = feats @ feats.T
        val, vec = np.linalg.eigh(gram.astype(np.float64))
        val = np.maximum(val, 1e-3)
        white = (vec / np.sqrt(val)) @ vec.T
        x_rows = np.concatenate([pos_words, neg])
        y = np.r_[np.ones(len(pos_words)), -np.ones(len(neg))]
        cost = np.r_[np.minimum(pos_n, 20) / np.minimum(pos_n, 20).mean() * (len(neg) / len(pos_words)) ** 0.5, np.ones(len(neg))]
        _, weight, _ = _plan()
        x = np.empty((len(x_rows), len(marks)))
        for a in range(0, len(x_rows), 512):
            part = rows[x_rows[a : a + 512]]
            idx = subsequences(part)
            k = np.stack([feats[m][idx] @ weight for m in range(len(marks))], axis=1) / norms(part, idx)[:, None]
            x[a : a + 512] = k @ white
        beta, bias = _svm(x, y, cost)
        model = Model(np.r_[(white @ beta) @ feats[:, :DIM], 0].astype(np.float32), bias, 0.0, 0.0, base)
        margin = model.rate(rows).astype(float)
    if model is flat:  # nothing to tell them apart by
        return flat
    best = np.maximum.reduceat(margin[place], bounds)
    truth = toxic[of].astype(float)
    slope, shift = _logistic(best, truth)
    return Model(model.fold, model.bias, slope, shift, base)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps."""
    z = np.c_[x, np.ones(len(x))]
    w = v = np.zeros(z.shape[1])
    scale = cost / cost.sum()
    lip = 2 * np.linalg.eigvalsh((z * scale[:, None]).T @ z)[-1] + penalty
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ v))
        grad = -2 * (z.T @ (scale * slack * y)) + penalty * np.r_[v[:-1], 0]
        new = v - grad / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t2 * (new - w), t2
    return w[:-1], float(w[-1])


def _logistic(m: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    a, b = 4.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - y) * m).sum() + 1e-2 * a, (p - y).sum()])
        r = p * (1 - p) + 1e-6
        h = np.array([[(r * m * m).sum() + 1e-2, (r * m).sum()], [(r * m).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.5)), float(b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, mod: int = 5, rest: int = 0) -> Model:
    """A model from the texts of at most ``per_class`` toxic and twice as many clean training documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    h = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(h, "doc_id").limit(per_class).union(known.where("toxic = 0").orderBy(h, "doc_id").limit(2 * per_class))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    # one text of each id, the first by hash, and each text once
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r"))
    texts = one.groupBy("r.text").agg(F.max("r.toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).orderBy("doc_id").collect()  # 3 * per_class at most
    return learn([r["text"] for r in texts], np.array([int(r["toxic"]) for r in texts], int))


def rate(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches):
        model, known = shared.value, {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            score, at = [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size == 0 or size + len(texts[to]) <= SLICE):
                    size += len(texts[to]) + 1
                    to += 1
                score += model.score(texts[at:to], known).tolist()
                at = to
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
