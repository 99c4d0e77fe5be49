"""Keys and references found in the data, to fill a catalog.

One aggregation a table gives each column's rows, nulls, bounds and approximate number
of values.  That rules out most columns and pairs; what is left is decided exactly, by
a grouping (keys) or an anti-join (references).  A reference also asks for equal names
once the tables' own prefixes are gone: among dense integer keys, values alone would
make every small table refer to every larger one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog

#: Types that keys are made of.
KEY_TYPES = ("tinyint", "smallint", "int", "bigint", "string", "date", "timestamp", "decimal(38,0)")
NEAR = 0.9  # of the rows, below which an approximate number of values rules a key out (its error is 2 %)
SKETCH = 128


@dataclass(frozen=True)
class Column:
    table: str
    name: str
    place: int
    kind: str
    rows: int
    filled: int
    values: int
    low: object
    high: object

    @property
    def family(self) -> str:
        return "integer" if self.kind.endswith("int") else self.kind


def profile(table: str, df: DataFrame) -> list[Column]:
    """The columns of key types, from one scan."""
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema) if f.dataType.simpleString() in KEY_TYPES]
    if not fields:
        return []
    told = [F.count(F.lit(1)).alias("rows")]
    for i, name, _ in fields:
        c = F.col(f"`{name}`")
        told += [F.count(c).alias(f"f{i}"), F.approx_count_distinct(c, 0.02).alias(f"v{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}")]
    got = df.agg(*told).first()
    return [Column(table, name, i, kind, got["rows"], got[f"f{i}"], got[f"v{i}"], got[f"l{i}"], got[f"h{i}"]) for i, name, kind in fields]


def _is_key(df: DataFrame, names: tuple[str, ...]) -> bool:
    return df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def key(df: DataFrame, columns: list[Column]) -> tuple[str, ...]:
    """The key of a table: a column without nulls or repetitions (integers first, then by place), else a pair of columns whose values fill it best; empty if there is none."""
    whole = [c for c in columns if c.rows and c.filled == c.rows]
    for c in sorted(whole, key=lambda c: (c.family != "integer", c.place)):
        if c.values >= NEAR * c.rows and _is_key(df, (c.name,)):
            return (c.name,)
    pairs = [(a, b) for a, b in combinations([c for c in whole if c.family == "integer" and c.values > 1], 2) if a.values * b.values >= NEAR * a.rows]
    for a, b in sorted(pairs, key=lambda p: (p[0].values * p[1].values, p[0].place, p[1].place)):
        if _is_key(df, (a.name, b.name)):
            return (a.name, b.name)
    return ()


def stem(name: str, columns: list[str]) -> str:
    """A column's name without the prefix that all columns of its table share."""
    prefix = reduce(lambda a, b: a if a == b else "", (c.partition("_")[0] for c in columns)) if len(columns) > 1 else ""
    return name.removeprefix(f"{prefix}_") if prefix else name


def _sample(df: DataFrame, name: str) -> DataFrame:
    """The SKETCH values of smallest hash: the same ones wherever they occur, so those of a subset that are missing in the whole say so."""
    c = F.col(f"`{name}`")
    return df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.lit(1)).select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SKETCH)


def _held(child: DataFrame, name: str, parent: DataFrame, key_name: str) -> bool:
    """Whether every value of a column is a value of the key: a few first, then all of them."""
    keys = parent.select(F.col(f"`{key_name}`").alias("k"))
    values = child.select(F.col(f"`{name}`").alias("v")).where("v IS NOT NULL")
    if not _sample(child, name).join(keys, F.col("v") == F.col("k"), "left_anti").isEmpty():
        return False
    return values.join(keys, F.col("v") == F.col("k"), "left_anti").isEmpty()


def references(tables: Mapping[str, DataFrame], columns: Mapping[str, list[Column]], keys: Mapping[str, tuple[str, ...]], by_name: bool = True) -> list[catalog.Relationship]:
    """Columns all of whose values stand in another table's key of one column; with ``by_name`` those of equal stem only."""
    out = []
    for parent, own in keys.items():
        if len(own) != 1:
            continue
        target = next(c for c in columns[parent] if c.name == own[0])
        for child, candidates in columns.items():
            for c in candidates:
                same = stem(c.name, tables[child].columns) == stem(target.name, tables[parent].columns)
                fits = c.family == target.family and c.filled and c.low >= target.low and c.high <= target.high and c.values <= 1.1 * target.values
                if child != parent and fits and (same or not by_name) and _held(tables[child], c.name, tables[parent], target.name):
                    out.append(catalog.Relationship(child, (c.name,), parent, (target.name,)))
    return sorted(out, key=lambda r: (r.from_table, r.from_columns, r.to_table))


def discovered(name: str, tables: Mapping[str, DataFrame]) -> catalog.Catalog:
    """A catalog of the tables with the keys and references that their data has."""
    columns = {t: profile(t, df) for t, df in tables.items()}
    keys = {t: key(df, columns[t]) for t, df in tables.items()}
    made = {t: catalog.Table(t, tuple((f.name, f.dataType.simpleString().upper()) for f in df.schema), keys[t]) for t, df in tables.items()}
    found = catalog.Catalog(name, "spark", made, tuple(references(tables, columns, keys)))
    found.validate()
    return found
