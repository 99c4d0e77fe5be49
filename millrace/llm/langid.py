"""Language identification by inference of a document's language mixture.

Each word has a likelihood under each language from hashed letter trigrams.
Expectation-maximisation finds the proportions of the languages in a document;
a language stays in its set only if the likelihood gained by it exceeds a
penalty that grows with the logarithm of the number of words.  The prediction
is the language of largest proportion, the score that proportion.  A document
keeps a single language without further search only where a bound on the best
likelihood of all languages together shows that no larger set can pay.

Every language with a labelled text is learned.  Its trigram table is fitted on a
bounded sample: about ``per_lang`` distinct training texts of each language, those
whose hash lies under a threshold (all, where a language has no more), read whole
and counted by the executors.  Prediction reads every text whole, in slices of
documents that shrink as languages are added; of a text longer than a slice only
the distinct words are held.

Edge cases: a text that is null or has no letters is ``und`` with score 0; ties
go to the language first by code point; repeated rows are predicted each and
learned once; rows without an id are learned and predicted like others; a table
without labelled rows predicts ``und`` for all, an empty table gives no row.  A word
longer than a slice is read in pieces.  ``identify`` reads doc_id, text and lang
alone; ``accepted`` passes all columns through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import tidy
from ._text import mix

BUCKETS = 1 << 16
SLICE = 1 << 19
BROADCAST_ROWS = 100_000
_alpha: list[np.ndarray] = []


def alpha() -> np.ndarray:
    """Which code points are letters."""
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket of each letter, index of its word, document of each word, has letters)."""
    low = [t.lower() for t in texts]
    joined = " " + " ".join(low) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(alpha()[np.minimum(code, 0x10FFFF)], code, np.uint32(32))
    at = np.flatnonzero(code != 32)
    c = code.astype(np.uint64)
    h = (c[at - 1] * np.uint64(0x9E3779B1) + c[at]) * np.uint64(0x85EBCA77) + c[at + 1]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    ends = np.cumsum([len(t) + 1 for t in low])
    starts = np.flatnonzero(first)
    docs = np.searchsorted(ends, at[starts] - 1, "right") if len(starts) else np.zeros(0, np.int64)
    return h.astype(np.int64), starts, docs, np.bincount(docs, minlength=len(texts)) > 0


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log likelihood of each trigram bucket under each language, float32

    def predict(self, texts: list[str], rounds: int = 12, penalty: float = 2.0) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        pred, score = ["und"] * n, np.zeros(n)
        if not self.langs:
            return pred, score
        h, starts, docs, has = letters(texts)
        if len(starts):
            live = np.flatnonzero(has)
            slot = np.searchsorted(live, docs)
            bounds = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            chosen = _mixtures(self._words(h, starts), np.ones(len(slot)), bounds, rounds, penalty)
            for j, d in enumerate(live):
                w = int(chosen[j].argmax())
                pred[d], score[d] = self.langs[w], float(min(1.0, chosen[j, w]))
        return pred, score

    def predict_long(self, text: str, rounds: int = 12, penalty: float = 2.0) -> tuple[str, float]:
        """predict() of one text, a slice at a time: only its distinct words are held."""
        if not self.langs:
            return "und", 0.0
        keys, ll, count = np.zeros(0, np.uint64), np.zeros((0, len(self.langs))), np.zeros(0)
        at = 0
        while at < len(text):
            to = min(len(text), at + SLICE)
            end = to
            while end < len(text) and end > at and text[end - 1].isalpha():
                end -= 1
            end = end if end > at else to  # a word longer than a slice
            h, starts, _, _ = letters([text[at:end]])
            at = end
            if not len(starts):
                continue
            place = np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))
            word = np.add.reduceat(mix(h.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(16)) + np.uint64(1)), starts)
            own, first, times = np.unique(word, return_index=True, return_counts=True)
            every = np.concatenate([keys, own])
            both, table = np.concatenate([count, times]), np.concatenate([ll, self._words(h, starts)[first]])
            keys, first, of = np.unique(every, return_index=True, return_inverse=True)
            ll, count = table[first], np.bincount(of, both)
        if not len(keys):
            return "und", 0.0
        chosen = _mixtures(ll, count, np.zeros(1, np.int64), rounds, penalty)[0]
        return self.langs[int(chosen.argmax())], float(min(1.0, chosen.max()))

    def _words(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log likelihood of each word under each language, some words at a time."""
        out = np.empty((len(starts), len(self.langs)))
        cuts = np.unique(np.r_[np.searchsorted(starts, np.arange(0, len(h), max(1, 4 * SLICE // len(self.langs)))), len(starts)])
        ends = np.r_[starts, len(h)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = np.add.reduceat(self.table[h[ends[a] : ends[b]]], starts[a:b] - starts[a], axis=0)
        return out

    def predict_all(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Predictions over slices of bounded size."""
        pred, score, at = [], [], 0
        limit = 4 * SLICE // max(4, len(self.langs))
        while at < len(texts):
            if len(texts[at]) > limit:
                p, s = self.predict_long(texts[at])
                pred.append(p)
                score.append(s)
                at += 1
                continue
            to, size = at, 0
            while to < len(texts) and len(texts[to]) <= limit and (size == 0 or size + len(texts[to]) <= limit):
                size += len(texts[to]) + 1
                to += 1
            p, s = self.predict(texts[at:to])
            pred += p
            score += s.tolist()
            at = to
        return pred, score


def _mixtures(ll: np.ndarray, count: np.ndarray, bounds: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Proportions by document of the languages kept; rows are words with their counts, ``bounds`` where documents begin."""
    like = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -60.0))
    words = np.add.reduceat(count, bounds)
    single = np.add.reduceat(np.log(like) * count[:, None], bounds, axis=0)
    slot = np.repeat(np.arange(len(bounds)), np.diff(np.r_[bounds, len(like)]))
    share, full, gap = _em(like, count, slot, bounds, words, np.ones(single.shape, bool), rounds)
    cost = penalty * np.log(words + 1.0)
    chosen = np.zeros(single.shape)
    chosen[np.arange(len(bounds)), single.argmax(axis=1)] = 1.0
    # no larger set can win where even the best mixture of all languages gains less than the price of one
    more = np.flatnonzero(full + gap - single.max(axis=1) > cost)
    if len(more):
        chosen[more] = _select(like, count, bounds, words, share, full, single, cost, more, rounds)
    return chosen


def _em(like, count, slot, bounds, words, mask, rounds):
    """Proportions by document under the allowed languages, the log likelihood they reach, and a bound on what the best ones gain beyond it."""
    share = mask / mask.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = like * share[slot]
        total = np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        last, share = share, np.add.reduceat(joint * (count[:, None] / total), bounds, axis=0) / words[:, None]
    # the likelihood is concave: no mixture exceeds that of ``last`` by more than words * log(max(share / last))
    reached = np.add.reduceat(np.log(total[:, 0]) * count, bounds)
    most = reached + words * np.log(np.maximum(1.0, np.where(last > 1e-200, share / np.maximum(last, 1e-200), 1.0).max(axis=1)))
    total = (like * share[slot]).sum(axis=1)
    full = np.add.reduceat(np.log(np.maximum(total, 1e-300)) * count, bounds)
    return share, full, np.maximum(0.0, most - full)


def _select(like, count, bounds, words, share, full, single, cost, more, rounds):
    """Backward elimination for the documents ``more``: drop the least language while that pays."""
    ends = np.r_[bounds[1:], len(like)]
    take = np.concatenate([np.arange(bounds[j], ends[j]) for j in more])
    size = (ends - bounds)[more]
    like, count, slot = like[take], count[take], np.repeat(np.arange(len(more)), size)
    bounds, words, cost = np.r_[0, np.cumsum(size)[:-1]], words[more], cost[more]
    share, fit = share[more].copy(), full[more].copy()
    mask = np.ones_like(share, bool)
    open_ = np.ones(len(more), bool)
    for _ in range(share.shape[1] - 1):
        least = np.where(mask, share, np.inf).argmin(axis=1)
        trial = mask.copy()
        trial[np.arange(len(more)), least] = False
        new_share, new_fit, _ = _em(like, count, slot, bounds, words, trial, rounds)
        better = open_ & (trial.any(axis=1)) & (fit - new_fit < cost)
        mask[better], share[better], fit[better] = trial[better], new_share[better], new_fit[better]
        open_ &= better & (mask.sum(axis=1) > 1)
        if not open_.any():
            break
    alone = single[more].max(axis=1) >= fit - cost * np.maximum(0, mask.sum(axis=1) - 1)
    out = np.where(mask, share, 0.0)
    rows = np.flatnonzero(alone)
    out[rows] = 0.0
    out[rows, single[more][rows].argmax(axis=1)] = 1.0
    return out


def held_out(doc_id, mod: int, rest: int):
    """crc32 of the id's digits, modulo ``mod``, is ``rest``; a null id counts as no digits."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def _trigrams(batches):
    """(lang, counts by trigram bucket) of rows sorted by language."""
    now, total = None, None

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([total.tobytes()], pa.binary())], ["lang", "counts"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang != now:
                if now is not None:
                    yield flush()
                now, total = lang, np.zeros(BUCKETS, np.int64)
            total += np.bincount(letters([text])[0], minlength=BUCKETS)
    if now is not None:
        yield flush()


def fit(docs: DataFrame, per_lang: int = 400, mod: int = 4, rest: int = 2) -> Model:
    """Trigram tables of every language from a bounded sample of its distinct training texts."""
    train = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), mod, rest) & F.col("text").isNotNull())
    train = train.select("lang", "text", F.xxhash64("text").alias("h"))
    keys = train.select("lang", "h").distinct()
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    # of n distinct texts those whose hash lies in the lowest per_lang / n of its range
    picked = keys.join(sizes, "lang").where(F.col("h").cast("double") < F.lit(2.0**64) * F.lit(float(per_lang)) / F.col("n") - F.lit(2.0**63)).select("lang", "h")
    picked = F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked
    rows = train.join(picked, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    summed = rows.select("lang", "text").repartition("lang").sortWithinPartitions("lang").mapInArrow(tidy(_trigrams), "lang string, counts binary")
    counts: dict[str, np.ndarray] = {}
    for r in summed.toLocalIterator():
        part = np.frombuffer(bytes(r["counts"]), np.int64)
        counts[r["lang"]] = counts[r["lang"]] + part if r["lang"] in counts else part
    names = sorted(counts)
    table = np.empty((BUCKETS, len(names)), np.float32)
    for i, name in enumerate(names):
        smooth = counts[name] + 0.05
        table[:, i] = np.log(smooth / smooth.sum())
    return Model(names, table)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(row columns of ``docs``..., lang_pred, lang_score): every text read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns]

    def run(batches):
        model = shared.value
        for batch in batches:
            pred, score = model.predict_all([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*others, "lang_pred", "lang_score"])

    return docs.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, lang_score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang)."""
    model = fit(docs, **options)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def accepted(docs: DataFrame, least: float = 0.35, **options) -> DataFrame:
    """Rows of ``docs`` (all columns, nothing added) with a language: not ``und``, and of a proportion of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))

    def run(batches):
        for batch in batches:
            pred, score = shared.value.predict_all([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
