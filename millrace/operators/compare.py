"""Comparison of results and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with their surplus in a (positive) or in b (negative); empty if the multisets are equal.

    One aggregation over both sides; nulls compare as equal.
    """
    if len(a.columns) != len(b.columns):
        raise ValueError("results have different numbers of columns")
    b = b.toDF(*a.columns)
    both = a.withColumn("surplus", F.lit(1)).unionByName(b.withColumn("surplus", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("surplus").alias("surplus")).where("surplus <> 0")


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    return multiset_difference(a, b).isEmpty()


def ordered_difference(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """Positions at which two results with an explicit row number differ."""
    cols = [c for c in a.columns if c != position]
    x = a.select(position, F.struct(*cols).alias("left"))
    y = b.toDF(*a.columns).select(position, F.struct(*cols).alias("right"))
    return x.join(y, position, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def rows_hash(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """SHA-256 of a (row-capped) result: tabs between values, line feeds between rows."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    lines = df.select(F.struct(*[k.alias(f"o{i}") for i, k in enumerate(keys)], line.alias("line")).alias("r"))
    return lines.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n"), 256).alias("rows_hash"))


def row_prints(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row, null told apart from every value and place."""
    told = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(seed), *told) for seed in (1, 2)]


def paired_results(rows: DataFrame, pair: str, side: str, columns: Sequence[str]) -> DataFrame:
    """(pair, rows_a, rows_b, equal): for each pair whether its sides ``a`` and ``b`` are the same multiset of rows.

    One job for all pairs.  A side's sums of row hashes (128 bits, in any order) and its
    count decide that two sides differ, combined before the shuffle however large a
    result is; pairs with equal sums are then recounted row by row, so a pair is called
    equal only if every row stands as often on both sides.  A side without a row is empty.
    """
    one, two = row_prints(columns)
    sign = F.when(F.col(side) == "a", 1).when(F.col(side) == "b", -1)
    signed = rows.select(F.col(pair).alias("pair"), sign.alias("sign"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], one.alias("h1"), two.alias("h2"))

    def balance(c: str) -> Column:
        return F.sum(F.col(c).cast("decimal(38,0)") * F.col("sign"))

    sums = signed.groupBy("pair").agg(F.count_if(F.col("sign") == 1).alias("rows_a"), F.count_if(F.col("sign") == -1).alias("rows_b"), balance("h1").alias("s1"), balance("h2").alias("s2"))
    judged = sums.select("pair", "rows_a", "rows_b", ((F.col("rows_a") == F.col("rows_b")) & (F.col("s1") == 0) & (F.col("s2") == 0)).alias("alike"))
    alike = judged.where("alike").select(F.col("pair").alias("like"))
    again = signed.join(alike, F.col("pair").eqNullSafe(F.col("like")), "left_semi").groupBy("pair", *[f"c{i}" for i in range(len(columns))]).agg(F.sum("sign").alias("surplus"))
    wrong = again.where("surplus <> 0").select(F.col("pair").alias("wrong")).distinct()
    found = judged.join(wrong.withColumn("hit", F.lit(True)), F.col("pair").eqNullSafe(F.col("wrong")), "left")
    return found.select(F.col("pair").alias(pair), "rows_a", "rows_b", (F.col("alike") & F.col("hit").isNull()).alias("equal"))


#: What two reports must share to be compared.
CONTRACT = ("fingerprint", "examples", "max_new_tokens", "max_context_characters")


def compare_reports(a: dict, b: dict) -> dict[str, float]:
    """Differences b - a of all rates of two reports under one contract."""
    for key in CONTRACT:
        if a.get(key) != b.get(key):
            raise ValueError(f"reports differ in {key}")
    return {k: b[k] - a[k] for k in a if k.endswith("_rate") and k in b}


def metric_deltas(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of two groups side by side, with their difference."""
    x = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    y = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    joined = x.join(y, list(keys)) if keys else x.crossJoin(y)  # without keys: one row each
    return joined.withColumns({f"{m}_delta": F.col(f"{m}_b") - F.col(f"{m}_a") for m in metrics})


def approved(policy: Column, schema_valid: Column, exact: Column, executed: Column, reference_rows: Column, equal: Column) -> Column:
    """A candidate passes by exact form, or by equal results over a non-empty reference."""
    return F.coalesce(policy & schema_valid & (exact | (executed & (reference_rows > 0) & equal)), F.lit(False))
