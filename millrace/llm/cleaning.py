"""Line-first cleaning: rules judge lines, failing lines go, and a document that loses too much of its words goes with them.

A line fails by the first rule that it breaks:

* symbols: more than one of ``#*$%&|<>`` for every four words (markup, tables, padding);
* navigation: two or more separators, at least one for every three words;
* boilerplate: one of the fixed phrases below, of any case;
* punctuation: no sentence end at the end of the line (closing quotes and brackets
  aside), unless the line has ``LONG_LINE`` words and a finished sentence inside, as a
  paragraph cut off in its last sentence has.

Lines without a word are neither kept nor lost.  A document is rejected by the
base rules (too few words, too many words in repeated three-word windows) or if
more than ``max_lost`` percent of its words stood in failing lines.  Every document is
judged where it is read: there is no shuffle.

Edge cases: a null or empty text has no word and fails the base rules; repeated
rows and ties fare alike; a very long text is judged whole, its windows as integer
arrays; an empty table gives no row.  All columns of the input are kept under their
names; where it has a column of an added name, underscores are put before the added one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ._session import tidy
from .mixing import free_names

WHITE = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT, MAX_LOST, LONG_LINE = 50, 50, 40, 12
#: Characters and phrases the rules look for.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·→"
CLOSERS = "\"')]}»”’"
ENDS = ".!?…:;。！？"
BOILERPLATE = (
    "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "follow us on", "licensed under", "log in",
    "lorem ipsum", "newsletter", "privacy policy", "read more", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use", "use cookies", "uses cookies",
)

_SYMBOLS, _SEPARATORS = SYMBOLS.encode(), re.compile(f"[{SEPARATORS}]")
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_END = re.compile(f"[{re.escape(ENDS)}][{re.escape(CLOSERS)}]*$")
_INSIDE = re.compile("[.!?…][\x20\x09]")


def line_defect(line: bytes) -> str | None:
    """The rule that a line with a word breaks, or None."""
    words = len(line.split())
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    if 4 * symbols > words:
        return "symbols"
    text = line.strip(WHITE).decode("utf-8", "replace")
    separators = 0 if line.isascii() and not symbols else len(_SEPARATORS.findall(text))
    if separators >= 2 and 3 * separators >= words:
        return "navigation"
    if _PHRASES.search(line.translate(_LOWER)):
        return "boilerplate"
    if not _END.search(text) and not (words >= LONG_LINE and _INSIDE.search(text)):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of ``width`` words found twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    rank = ids[:n]
    for i in range(1, width):  # ranks of ever longer windows: exact, and below the square of the number of words
        _, rank = np.unique(rank * len(known) + ids[i : i + n], return_inverse=True)
    twice = np.bincount(rank)[rank] > 1
    inside = np.zeros(len(words), bool)
    for i in range(width):
        inside[i : i + n] |= twice
    return int(inside.sum())


#: Columns added by judged(), with their Arrow types.
ADDED = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "n_failed_lines": pa.int64(), "n_lost_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string(),
}


def judge(raw: bytes, max_lost: int, with_text: bool) -> tuple:
    """The values of ADDED for one text."""
    words = raw.split()
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip(WHITE)]
    bad = {x for x in set(full) if line_defect(x)}
    lost = sum(len(x.split()) for x in full if x in bad)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT * len(words)
    kept = not failed and 100 * lost <= max_lost * len(words)
    chars = len(raw.translate(None, WHITE).decode("utf-8", "replace"))
    text = b"\n".join(x for x in lines if x not in bad).decode("utf-8", "replace") if with_text else None
    return len(words), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(full) - len(set(full)), repeat, sum(x in bad for x in full), lost, failed, kept, text


def judged(docs: DataFrame, max_lost: int = MAX_LOST, with_text: bool = True) -> DataFrame:
    """All rows and columns of ``docs``, and the columns ADDED under free names; ``clean_text`` is null without ``with_text``."""
    names = free_names(docs.columns, list(ADDED))
    schema = StructType([*docs.schema.fields, *from_arrow_schema(pa.schema([(names[k], t) for k, t in ADDED.items()])).fields])
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            rows = [judge(x.as_py() or b"", max_lost, with_text) for x in batch.column(place).cast(pa.binary())]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(ADDED.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names.values()])

    return docs.mapInArrow(tidy(run), schema)


def cleaned(docs: DataFrame, max_lost: int = MAX_LOST) -> DataFrame:
    """The documents that are kept, with their columns and their text without failing lines."""
    names = free_names(docs.columns, list(ADDED))
    out = judged(docs, max_lost).where(F.col(names["kept"]))
    return out.select(*[F.col(names["clean_text"]).alias(c) if c == "text" else F.col(c) for c in docs.columns])
