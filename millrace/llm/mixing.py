"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a 60-bit hash of its id.  A source's extra copies are those
of its documents whose hash lies under a threshold; the threshold is found from
sums of tokens by (source, hash bucket): the bucket in which the running sum
passes the budget is refined by the next 12 bits, all others are settled, and
nothing is ever sorted.  Thresholds of the first, second, ... copy are nested:
a source gets ``q`` whole copies and one more of the documents under its
threshold.

Edge cases: a null text has size 0; a null source is a source of its own and
comes last; rows with a null id are hashed by their text; rows of equal id share
a hash and are taken or left together (ties); a source of only empty texts keeps one
copy of each (size 0); a very long text is one size like any other; an empty table
gives an empty result.  Columns of the input are never changed: where it has a
column of an added name, underscores are put before the added one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import cut

BITS, LEVEL_BITS = 60, 12
BROADCAST_ROWS = 100_000


def id_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of the id (of the text where the id is null)."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    """Number of maximal runs outside ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def free_names(columns: list[str], wanted: list[str]) -> dict[str, str]:
    """A name for each wanted column that no given column has (names are compared without case)."""
    taken = {c.lower() for c in columns}
    out = {}
    for name in wanted:
        free = name
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out[name] = free
    return out


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): water-filling of ``share`` x all sizes by weight, at most ``cap`` x size each.

    Sources are sorted by the rate at which they fill up; the first that does not
    fill gives the rate of all that remain, which is where resharing ends.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(0))
    place = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    src = src.withColumn("w", weight).withColumn("fill", F.col("source_size") * F.lit(cap) / F.col("w"))
    order = every.orderBy("fill", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    src = src.withColumn(
        "rate",
        (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap)) / F.sum("w").over(after),
    )
    open_rate = F.max(F.when(F.col("rate") < F.col("fill"), F.col("rate"))).over(every)
    target = F.least(F.col("source_size") * F.lit(cap), F.coalesce(open_rate * F.col("w"), F.col("source_size") * F.lit(cap)))
    return src.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Add (full, below): whole copies of each source, and the hash under which one more is taken."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    state = targets.withColumn("full", whole.cast("bigint")).withColumn("need", F.col("target") - F.col("full") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("bigint"))
    few = targets.count() <= BROADCAST_ROWS  # one row a source: sent to all tasks only after counting them
    for done in range(0, BITS, LEVEL_BITS):
        shift = BITS - done - LEVEL_BITS
        edge = state.where(F.col("prefix").isNotNull()).select(F.col("source").alias("s"), "prefix", "need")
        inside = sized.join(F.broadcast(edge) if few else edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        bucket = F.shiftright("h", shift)
        hist = inside.groupBy("s", bucket.alias("b")).agg(F.sum("size").alias("n"), F.first("need").alias("need"))
        run = F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("run", run).where(F.col("run") > F.col("need"))
        at = hist.groupBy("s").agg(F.min_by(F.struct("b", (F.col("need") - F.col("run") + F.col("n")).alias("left"), "n"), "b").alias("e"))
        # one row a source, read twice by the next level: cut, or the plan would double with each level
        state = cut(
            state.drop("prefix", "need", "n")
            .join(at, F.col("source").eqNullSafe(F.col("s")), "left")
            .select(*targets.columns, "full", F.col("e.b").alias("prefix"), F.col("e.left").alias("need"), F.col("e.n").alias("n"))
        )
    nearer = (F.col("n") < F.col("need") * 2).cast("bigint")
    return state.select(*targets.columns, "full", (F.col("prefix") + nearer).alias("below"))


MIXED = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, source, ...), and the columns MIXED under free names."""
    names = free_names(docs.columns, MIXED)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    packed = docs.select(row, F.col("source").alias("source"), word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id"), F.col("text")).alias("h"))
    sized = cut(packed.select("source", "size", "h"))
    levels = cut(thresholds(sized, cut(source_targets(sized, weights, share, cap))))
    levels = levels.withColumnRenamed("source", "of")
    # one row a source: sent to all tasks only after counting them
    levels = F.broadcast(levels) if levels.count() <= BROADCAST_ROWS else levels
    joined = packed.join(levels, F.col("source").eqNullSafe(F.col("of")), "left")
    copies = F.col("full") + F.coalesce((F.col("h") < F.col("below")).cast("bigint"), F.lit(0))
    made = {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_copies": copies, "mix_taken": copies * F.col("size")}
    return joined.select("row.*", *[made[k].alias(names[k]) for k in MIXED])


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` (all columns, nothing added) as often as it is taken."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"))
    mixed = mix(packed, **options).where(F.col("mix_copies") > 0)
    times = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("mix_copy")
    return mixed.select("mix_row", times).select("mix_row.*")
