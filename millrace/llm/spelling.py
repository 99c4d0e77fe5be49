"""Spelling variants by a symmetric-delete join.

Words of a corpus are counted inside the tasks, summed, and kept from
``min_count`` occurrences on.  Every word emits a 64-bit key of itself and of each
of its distinct single deletions; words that share a key are joined and verified
to be one edit apart.  Two words one edit apart share exactly one key (the
shorter word, or what both leave when the replaced letter goes), so no pair
comes twice, and a key has at most as many words as there are letters to insert.
A word's form is its most frequent near word, if that is ``ratio`` times as frequent;
forms lead on to other forms, and roots are found by doubling the steps.  Counts
grow by ``ratio`` with each step, so there are no cycles and a few rounds suffice.

Words of up to ``CARRIED`` code points travel with their keys; longer ones travel as
ids, so a word of n letters takes n rows of fixed size, and are looked up for the
verification.

Edge cases: a null or empty text has no word; a null doc_id is the empty text in
the hash that chooses letters to delete; repeated rows count each; a very long text
is read in slices between words; words equally frequent (ties) go by code point;
an empty table gives no row.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import cut, stored, tidy

LETTERS = "a-zÀ-ÿ"  # after lower-casing A-Z
SLICE, FLUSH, CARRIED = 1 << 20, 1 << 17, 128
_RUN, _OTHER = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE characters, cut between words."""
    at = 0
    while at < len(text):
        end = _OTHER.search(text, at + SLICE)
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def varied(doc: str, text: str, every: int) -> Iterator[tuple[str, int]]:
    """(word, count) of a text; a word whose hash with the document ``every`` divides loses one letter."""
    start = zlib.crc32(f"{doc}:".encode())
    for part in _slices(text):
        for run, n in Counter(_RUN.findall(part)).items():
            h = zlib.crc32(run.encode(), start)
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            yield run, n


def word_counts(docs: DataFrame, min_chars: int = 6, every: int = 199) -> DataFrame:
    """(word, n) over all texts, for words of at least ``min_chars`` code points."""

    def count(batches):
        found: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text").cast(pa.binary()), strict=True):
                raw = text.as_py()
                if not raw:
                    continue
                for word, n in varied(doc.as_py(), raw.translate(_LOWER).decode("utf-8", "replace"), every):
                    if len(word) >= min_chars:
                        found[word] += n
                if len(found) > FLUSH:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(word) -> F.Column:
    """64-bit hashes of a word and of its distinct single deletions."""
    size = F.length(word)
    less = F.transform(F.sequence(F.lit(1), size), lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), less))


def _sorted(side: DataFrame) -> DataFrame:
    """``side`` for a sort-merge join: its size is guessed from compressed files, before keys are made of it, and a broadcast would pass all of it through the driver."""
    return side.hint("merge")


def _shared(words: DataFrame, *payload: str) -> DataFrame:
    """Candidate pairs: rows (a_*, b_*) of ``payload`` for each key that two words share, id of a before id of b."""
    keyed = words.select(F.explode(deletion_keys(F.col("word"))).alias("key"), *payload)
    a, b = (keyed.select("key", *[F.col(c).alias(f"{side}_{c}") for c in payload]) for side in "ab")
    return a.join(_sorted(b), "key").where("a_id < b_id").drop("key")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words (id, word, n) one inserted, deleted or replaced code point apart, once."""
    size = F.length("word")
    one_edit = F.levenshtein("a", "b", 1) == 1
    out = ["a", "a_n", "b", "b_n"]
    short = _shared(words.where(size <= CARRIED), "id", "word", "n").withColumnsRenamed({"a_word": "a", "b_word": "b"}).where(one_edit).select(out)
    long = words.where(size >= CARRIED)
    if long.isEmpty():
        return short
    by_id = _shared(long, "id", "n")
    for side in "ab":
        by_id = by_id.join(_sorted(long.select(F.col("id").alias(f"{side}_id"), F.col("word").alias(side))), f"{side}_id")
    # pairs of two words of CARRIED letters are in both parts
    fresh = F.greatest(F.length("a"), F.length("b")) > CARRIED
    return short.unionByName(by_id.where(fresh & one_edit).select(out))


def forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, if ``ratio`` times as frequent."""
    pairs = near_pairs(words)
    both = F.array(*[F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("near")).alias("at")) for x, y in ("ab", "ba")])
    found = pairs.select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("at").alias("at"))
    fits = -F.col("at.less") >= F.col("n") * ratio
    return words.join(_sorted(found), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("at.near")).alias("form"), F.when(fits, -F.col("at.less")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the last of its chain of forms, in doubling steps."""
    steps = cut(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(steps.join(_sorted(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return steps
        steps = moved.drop("next")


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least ``min_chars`` code points and ``min_count`` occurrences."""
    kept = word_counts(docs, min_chars, every).where(F.col("n") >= min_count)
    words = stored(kept.withColumn("id", F.monotonically_increasing_id()), "words")  # ids are fixed once written
    found = stored(forms(words, ratio), "forms")
    return found.join(_sorted(roots(found)), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
