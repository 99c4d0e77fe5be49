"""Corpus transforms, each DataFrame in, DataFrame out.

Order-sensitive rules (first wins, stable rank) take an explicit position column,
since rows have no order across partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import free
from ..functions.text import blank, collapse, content_hash, hash_bucket, line_ends, question_key
from ..sources import shared

#: Order in which a row's defects are looked for.
REASONS = ("missing_required_field", "too_long", "invalid_sql", "multiple_sql_statements", "duplicate")


def normalize(df: DataFrame, question: str, schema: str, sql: str) -> DataFrame:
    """Questions collapsed, DDL and SQL with plain line ends."""
    return df.withColumns({question: collapse(F.col(question)), schema: line_ends(F.col(schema)), sql: line_ends(F.col(sql))})


def with_rejection(df: DataFrame, fields: Sequence[str], max_characters: int = 16_000, verdict: str | None = None) -> DataFrame:
    """Add ``reason``: the first defect of a row by fixed precedence, null for none.

    ``verdict`` names a column of the parse gate: null (fine), or the reason.
    """
    missing = F.lit(False)
    longest = F.greatest(*[F.length(f) for f in fields]) if len(fields) > 1 else F.length(fields[0])
    for f in fields:
        missing = missing | blank(F.col(f))
    reason = F.when(missing, F.lit(REASONS[0])).when(longest > max_characters, F.lit(REASONS[1]))
    return df.withColumn("reason", reason.otherwise(F.col(verdict)) if verdict else reason)


def parse_verdicts(df: DataFrame, column: str, store: str | None = None, batch: int = 2_000) -> DataFrame:
    """Add ``verdict`` of the parse gate to each row; one SQL text of each shape (gate.shape) is parsed.

    Verdicts are appended to the folder ``store`` in batches, the only ones the driver
    holds; called again with that folder, only texts without a verdict are parsed.
    """
    from ..plans import gate
    from ..plans.analyze import with_analysis

    spark = df.sparkSession

    def judge(sql: str) -> tuple[str | None]:
        parts = gate.statements(sql)
        if len(parts) > 1:
            return ("multiple_sql_statements",)
        try:
            gate.parse(spark, parts[0] if parts else "")
        except Exception:
            return ("invalid_sql",)
        return (None,)

    return with_analysis(df, column, judge, "verdict string", gate.shape, store=store, batch=batch, growing=True)


def first_of(df: DataFrame, keys: Sequence[Column | str], position: str) -> DataFrame:
    """Exact dedup: of each key the row of smallest position.

    A minimum of structs combines within a task before the shuffle, so a hot key
    does not gather its rows; a window would.
    """
    packed = df.select(*[F.col(k).alias(f"_k{i}") if isinstance(k, str) else k.alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(F.col(position).alias("_p"), F.struct("*").alias("_row")).alias("_s"))
    return packed.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_s", "_s._p").alias("_s")).select("_s._row.*")


def dedup_exact(df: DataFrame, fields: Sequence[str], position: str) -> DataFrame:
    return first_of(df, [content_hash(*[F.col(f) for f in fields])], position)


def rejection_histogram(df: DataFrame, fields: Sequence[str], position: str, max_characters: int = 16_000, verdict: str | None = None) -> DataFrame:
    """(reason, rows): every input row counted once, duplicates among the accepted last."""
    judged = with_rejection(df, fields, max_characters, verdict)
    key = content_hash(*[F.col(f) for f in fields])
    sound = judged.where(F.col("reason").isNull()).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    counts = sound.agg(F.count(F.lit(1)).alias("accepted"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"))
    counts = counts.select(F.expr("stack(2, 'accepted', accepted, 'duplicate', duplicate) AS (reason, rows)"))
    bad = judged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    return bad.unionByName(counts).where("rows > 0")


def group_split(df: DataFrame, group: Column, percent: int) -> DataFrame:
    """Add ``schema_group`` and ``split``: whole groups go to validation by hash."""
    if not 1 <= percent <= 50:
        raise ValueError("percent must be in 1..50")
    out = df.withColumn("schema_group", F.sha2(group, 256))
    return out.withColumn("split", F.when(hash_bucket(F.col("schema_group")) < percent, "validation").otherwise("train"))


def leaking_groups(df: DataFrame, group: str = "schema_group", split: str = "split") -> DataFrame:
    """Groups that stand on both sides; an empty result is a clean split."""
    return df.groupBy(group).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b").select(group)


def family_holdout(df: DataFrame, family: str, held: Sequence[str]) -> DataFrame:
    return df.withColumn("split", F.when(F.col(family).isin(*held), "validation").otherwise("train"))


def messages(system: Column, question: Column, answer: Column) -> Column:
    """Three chat messages as an array of structs."""
    roles = (("system", system), ("user", question), ("assistant", answer))
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in roles])


def collect_ordered(df: DataFrame, key: str, position: str, values: Sequence[str], name: str) -> DataFrame:
    """One row a key with its rows as an array in order of position."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, *values))).alias(name))


def top_by_hash(df: DataFrame, parts: Sequence[Column], n: int) -> DataFrame:
    """The n rows of smallest hash: a sample that depends on content alone, as a top-k."""
    (h,) = free(df, "hash")
    return df.withColumn(h, F.sha2(F.concat_ws(":", *parts), 256)).orderBy(h).limit(n).drop(h)


def first_n(df: DataFrame, position: str, n: int) -> DataFrame:
    return df.where(F.col(position) < n)


def stratified_sample(df: DataFrame, bucket: str, key: Column, n: int, order: Sequence[str]) -> DataFrame:
    """n rows in near-equal parts from the non-empty buckets; what is missing is filled bucket by bucket in ``order``.

    Buckets that ``order`` does not name, null among them, come after the named ones, by value.
    A bucket gives at most n rows, so ranks are only needed for its n smallest
    keys (a per-partition top-k before the shuffle).
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    k, rank = free(df, "key", "rank")
    ranked_rows = df.withColumn(k, key).withColumn(rank, F.row_number().over(Window.partitionBy(bucket).orderBy(k))).where(F.col(rank) <= n)
    sizes = {r[0]: r[1] for r in ranked_rows.groupBy(bucket).agg(F.max(rank)).collect()}
    more = sorted((b for b in sizes if b not in order), key=lambda b: (b is None, str(b)))
    present = [b for b in [*order, *more] if sizes.get(b)]
    if not present:
        raise ValueError("nothing to sample from")
    quota = n // len(present)
    take = {b: min(quota, sizes[b]) for b in present}
    left = n - sum(take.values())
    for b in present:
        extra = min(left, sizes[b] - take[b])
        take[b] += extra
        left -= extra
    wanted = F.lit(False)
    for b, c in take.items():
        wanted = wanted | (F.col(bucket).eqNullSafe(F.lit(b)) & (F.col(rank) <= c))
    return ranked_rows.where(wanted).drop(k, rank)


def overlapping(df: DataFrame, key: Column, frozen: DataFrame, frozen_key: Column) -> DataFrame:
    """Rows whose key stands in the frozen benchmark; must be empty before training."""
    return _by_key(df, key, frozen, frozen_key, "left_semi")


def without_overlap(df: DataFrame, key: Column, frozen: DataFrame, frozen_key: Column) -> DataFrame:
    return _by_key(df, key, frozen, frozen_key, "left_anti")


def _by_key(df: DataFrame, key: Column, frozen: DataFrame, frozen_key: Column, how: str) -> DataFrame:
    (k,) = free(df, "key")
    return df.withColumn(k, key).join(frozen.select(frozen_key.alias(k)).distinct(), k, how).select(*df.columns)


def repeated(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys that occur more than once, with their counts; must be empty."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def repeated_questions(df: DataFrame, question: str) -> DataFrame:
    return repeated(df, question_key(F.col(question)).alias("question_key"))


def expand(values: DataFrame, templates: DataFrame, row: str = "row_number", template: str = "template_number") -> DataFrame:
    """Template expansion: every row of values with every template of its family."""
    return values.join(templates, "family").withColumn("id", F.format_string("%s-%03d-p%d", "family", row, template))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace {name} by a column's value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def pending(jobs: DataFrame, done: DataFrame, key: str = "id", limit: int | None = None) -> DataFrame:
    """Jobs without a response."""
    out = jobs.join(done.select(key).distinct(), key, "left_anti")
    return out.limit(limit) if limit is not None else out


def rates(df: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each flag its count and rate, over all rows or by group."""
    aggs = [F.count(F.lit(1)).alias("examples")]
    for f in flags:
        yes = F.coalesce(F.col(f).cast("int"), F.lit(0))
        aggs += [F.sum(yes).cast("bigint").alias(f"{f}_count"), F.avg(yes).alias(f"{f}_rate")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank``, the place of each row in that order, from 0 and without gaps.

    Rows are dealt by ranges and sorted within them; a range's first rank is the sum of
    the sizes before it, so only one row a range ever meets in a task.  Rows are written
    out in between: a lost task cannot deal them otherwise.
    """
    spark = df.sparkSession
    path = shared.working_folder(spark, "ranked")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part, place, shift = free(df, "part", "place", "shift")
    dealt.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place)).write.mode("overwrite").parquet(path)
    dealt = spark.read.parquet(path)
    parts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(part, (before - F.col("least")).alias(shift))
    return dealt.join(F.broadcast(parts), part).select(*df.columns, (F.col(place) + F.col(shift)).alias("rank"))


def fingerprint(df: DataFrame, line: Column, position: Column, width: int = 4096, levels: int | None = None) -> DataFrame:
    """SHA-256 over all lines in order of an integer position: a tree of digests over their ranks.

    Lines are digested and ranked by position (nulls first; rows of one position by
    digest).  The digests of ``width`` successive ranks are digested as one, and of these
    again ``width``, until one is left, whatever the positions are: dense, sparse, negative
    or repeated.  No task holds more than ``width`` digests of a group; no line gives null.
    With ``levels`` the last of so many takes all digests that are left: with two, one
    task holds 65 bytes for each ``width`` lines, and a form that is fixed elsewhere
    (say, in SQL) is met at any number of lines.
    """
    lines = df.select(position.cast("bigint").alias("p"), F.sha2(line, 256).alias("d"))
    level = ranked(lines, "p", "d").select("rank", "d")
    left = level.count()
    for done in itertools.count(1):
        if done == levels:
            width = max(width, left)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda x: x["d"]), "\n")
        level = level.groupBy(F.floor(F.col("rank") / width).alias("g")).agg(F.sha2(text, 256).alias("d")).withColumnRenamed("g", "rank")
        left = -(-left // width)
        if left <= 1:
            return level.agg(F.any_value("d").alias("fingerprint"))


def orphans(child: DataFrame, parent: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Child rows without a parent; rows with a null key are not orphans."""
    condition, known = None, F.lit(True)
    for c, p in pairs:
        term = child[c] == parent[p]
        condition = term if condition is None else condition & term
        known = known & F.col(c).isNotNull()
    return child.join(parent, condition, "left_anti").where(known)


def tier_quota(df: DataFrame, tier: str, key: Column, shares: dict[str, int], n: int) -> DataFrame:
    """About n rows in fixed percentages by tier, the smallest hashes of each."""
    k, rank = free(df, "key", "rank")
    ranked_rows = df.withColumn(k, key).withColumn(rank, F.row_number().over(Window.partitionBy(tier).orderBy(k))).where(F.col(rank) <= n)
    wanted = F.lit(False)
    for t, share in shares.items():
        wanted = wanted | ((F.col(tier) == t) & (F.col(rank) <= n * share // 100))
    return ranked_rows.where(wanted).drop(k, rank)


def shuffled(df: DataFrame, seed: int, *parts: Column) -> DataFrame:
    """A seeded order that depends on content alone."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256))


def oversampled(df: DataFrame, n: int, factor: int, seed: int, fits: Column, *parts: Column) -> DataFrame:
    """n rows that fit (say, a length in tokens), from ``factor`` times as many drawn by seeded hash; fewer if not enough of those fit."""
    (h,) = free(df, "hash")
    drawn = df.withColumn(h, F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)).orderBy(h).limit(n * factor)
    return drawn.where(fits).orderBy(h).limit(n).drop(h)


def joined_by_id(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of both sides by id, counts of ids that are missing on either side)."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    missing = seen.agg(F.count_if(F.col("r") == 0).alias("missing_right"), F.count_if(F.col("l") == 0).alias("missing_left"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matched"))
    return left.join(right, key), missing
