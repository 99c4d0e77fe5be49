"""Column functions for text keys, hashes and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def line_ends(c: Column) -> Column:
    """CRLF and CR become LF; white space at both ends goes."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"^\s+|\s+$", "")


def question_key(c: Column) -> Column:
    """Lower case, collapsed: the key under which two questions are the same."""
    return collapse(F.lower(c))


def folded_key(c: Column) -> Column:
    """question_key() blind to what upper case makes equal as well: sharp s and ss, ligatures, both small sigmas.

    That is full case folding, but for dotless i (folded to i) and Cherokee letters.
    """
    upper = F.replace(F.upper(c), F.lit("ẞ"), F.lit("SS"))  # also keeps lower(upper(x)) from being taken for lower(x)
    return collapse(F.replace(F.lower(upper), F.lit("ς"), F.lit("σ")))


def content_hash(*parts: Column) -> Column:
    """SHA-256 over parts joined by the unit separator; with nulls among them, over that digest and which parts are null."""
    texts = [p.cast("string") for p in parts]
    joined = F.sha2(F.concat_ws("\x1f", *[F.coalesce(t, F.lit("")) for t in texts]), 256)
    absent = F.concat(*[F.when(t.isNull(), "1").otherwise("0") for t in texts])
    return F.when(F.contains(absent, F.lit("1")), F.sha2(F.concat(joined, F.lit(":"), absent), 256)).otherwise(joined)


def hash_bucket(digest: Column, buckets: int = 100) -> Column:
    """The first 32 bits of a hex digest, modulo ``buckets``."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("bigint")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""
