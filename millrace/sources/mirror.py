"""A prepared mirror of tables: bucketed and sorted by key, checked before it is used.

A version of the mirror is a folder of tables, dealt into the same number of buckets
by key and sorted within them, so joins on the keys need no Exchange.  It is checked
(repeated keys, null keys, orphans) and then named in the mirror's ledger; the entry
of the highest number is the current version, so readers see all tables of one
version or of the next, and a version that fails its check is never seen.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import files, shared
from .catalog import Catalog


class IntegrityError(ValueError):
    """A version whose tables break their catalog's keys or references."""


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The entries of the ledger in order."""
    fs, folder = shared.files(spark, f"{path}/_ledger")
    if not fs.exists(folder):
        return []
    rows = spark.read.text(f"{path}/_ledger/*.json", wholetext=True).collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda e: e["version"])


def prepare(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], catalog: Catalog, deal: Mapping[str, str], buckets: int = 64) -> int:
    """Write, check and publish a version; ``deal`` names the column by which each table is dealt (its key, or the reference it is joined by).  Returns its number."""
    known = versions(spark, path)
    number = known[-1]["version"] + 1 if known else 1
    entry = {"version": number, "buckets": buckets, "tables": {}}
    try:
        for name, df in tables.items():
            made = _table(name, path, number)
            spark.sql(f"DROP TABLE IF EXISTS {made}")
            df.repartition(buckets, deal[name]).write.mode("overwrite").bucketBy(buckets, deal[name]).sortBy(deal[name]).option("path", f"{path}/v{number}/{name}").saveAsTable(made)
            entry["tables"][name] = {"by": deal[name], "schema": df.schema.json()}
        bad = catalog.integrity({name: spark.table(_table(name, path, number)) for name in tables}).where("violations > 0").collect()
        if bad:
            raise IntegrityError("; ".join(f"{r['violations']} x {r['check']} of {r['subject']}" for r in bad))
    except Exception:
        _drop(spark, path, number, tables)
        raise
    fs, file = shared.files(spark, f"{path}/_ledger/{number:08d}.json")
    if not files._entered(fs, file, entry):
        raise RuntimeError(f"version {number} was published by another run")
    return number


def _table(name: str, path: str, number: int) -> str:
    return f"mirror_{zlib.crc32(path.encode()):08x}_{name}_v{number}"


def _drop(spark: SparkSession, path: str, number: int, tables: Mapping[str, DataFrame]) -> None:
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {_table(name, path, number)}")
    fs, folder = shared.files(spark, f"{path}/v{number}")
    fs.delete(folder, True)


def register(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the current (or a given) version, also as temp views; a session that did not write them learns their buckets from the ledger."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version of a mirror in {path}")
    entry = known[-1] if version is None else next(e for e in known if e["version"] == version)
    out = {}
    for name, told in entry["tables"].items():
        made = _table(name, path, entry["version"])
        if not spark.catalog.tableExists(made):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(told["schema"])))
            spark.sql(f"CREATE TABLE {made} ({columns}) USING parquet CLUSTERED BY (`{told['by']}`) SORTED BY (`{told['by']}`) INTO {entry['buckets']} BUCKETS LOCATION '{path}/v{entry['version']}/{name}'")
        out[name] = spark.table(made)
        out[name].createOrReplaceTempView(name)
    return out
