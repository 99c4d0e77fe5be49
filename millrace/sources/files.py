"""CSV, JSON-lines and manifest sources and sinks."""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared


def read_csv(spark: SparkSession, path: str, schema: str | None = None, line_breaks: bool = True) -> DataFrame:
    """A CSV with a header, fields of any length, and perhaps a byte-order mark.

    With ``line_breaks`` quoted fields may hold line breaks, and a file is read by one
    task; without, large files are split among tasks.  read_large_csv() does both.
    """
    reader = spark.read.options(header=True, multiLine=line_breaks, quote='"', escape='"', maxCharsPerColumn=-1)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


_PIECES = "file string, record long, block long, whole boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the lines of each block of each file, in order within a partition."""
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _quote_counts(batches):
    """(file, block, quotes, even, odd, returns): the quotes of a block, how many of its lines have an even or odd number of them before, and whether its first line ends in a carriage return."""
    now, found, returns = None, [0, 0, 0], False

    def out():
        return pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "quotes": found[0], "even": found[1], "odd": found[2], "returns": returns}], _COUNTS)

    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != now:
                if now:
                    yield out()
                now, found, returns = (file, block), [0, 0, 0], value.endswith("\r")
            found[1 + found[0] % 2] += 1
            found[0] += value.count('"')
    if now:
        yield out()


_COUNTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("even", pa.int64()), ("odd", pa.int64()), ("returns", pa.bool_())])


def _records(batches):
    """Records of each block: whole ones, and the pieces of those that go on in the next block or came from the one before."""
    now, held, record, quotes, begun = None, [], 0, 0, True
    out: dict[str, list] = {k: [] for k in ("file", "record", "block", "whole", "text")}

    def put(whole: bool) -> None:
        if held:
            for k, v in zip(out, (now[0], record, now[1], whole, "\n".join(held)), strict=True):
                out[k].append(v)
            held.clear()

    for batch in batches:
        for file, block, value, before, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != now:
                put(begun and quotes % 2 == 0)
                # the number of the record that is open, or of the one before the next that begins
                now, quotes, record, begun = (file, block), before, first - 1, False
            if quotes % 2 == 0:
                put(begun)
                record, begun = record + 1, True
            held.append(value)
            quotes += value.count('"')
        yield pa.RecordBatch.from_pydict(out, pa.schema([("file", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())]))
        for v in out.values():
            v.clear()
    put(begun and quotes % 2 == 0)
    yield pa.RecordBatch.from_pydict(out, pa.schema([("file", pa.string()), ("record", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())]))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 0 in each file, line breaks inside quotes kept (as line feeds in files whose first line ends in two characters).

    Every block of a file is read by a task of its own.  A line begins a record if an
    even number of quotes stands before it in the file: a first pass counts the quotes
    of each block, their prefix sums (a row a block) say where each block stands, and a
    second pass puts the lines together.  Only the pieces of records that cross a block
    limit meet in a shuffle.  Quotes inside fields are doubled, as RFC 4180 has it.
    """
    lines = _lines(spark, path)
    counts = lines.mapInArrow(_quote_counts, "file string, block long, quotes long, even long, odd long, returns boolean")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    starts = F.when(F.col("before") % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    placed = placed.withColumn("starts", starts).withColumn("first", F.coalesce(F.sum("starts").over(earlier), F.lit(0)))
    pieces = lines.join(F.broadcast(placed.select("file", "block", "before", "first")), ["file", "block"]).select("file", "block", "value", "before", "first").mapInArrow(_records, _PIECES)
    parts = pieces.where(~F.col("whole")).groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    plain = F.regexp_replace("text", "\r$", "")
    returns = placed.where("block = 0").select("file", "returns")
    both = pieces.where("whole").select("file", "record", "text").unionByName(parts).join(F.broadcast(returns), "file")
    return both.select("file", "record", F.when(F.col("returns"), F.replace(plain, F.lit("\r\n"), F.lit("\n"))).otherwise(plain).alias("text"))


def read_large_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """read_csv() with line breaks inside quotes, by as many tasks as the files have blocks; columns are strings without a ``schema``.

    The first record of each file is its header; a byte-order mark goes; empty records
    are skipped; fields are trimmed of nothing, and empty ones are null.
    """
    records = csv_records(spark, path)
    if schema is None:
        head = records.where("record = 0").select("text").first()
        names = next(csv.reader([head["text"].removeprefix("\ufeff")])) if head else []
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names) or "value string"
    body = records.where((F.col("record") > 0) & (F.col("text") != ""))
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "lineSep": "\u0001"}
    return body.select(F.from_csv("text", schema, options).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line raises.  With ``key``, missing or repeated ids raise."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key:
        bad = df.groupBy(key).count().where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "") | (F.col("count") > 1)).limit(1).collect()
        if bad:
            raise ValueError(f"missing or repeated {key}: {bad[0][key]}")
    return df


def read_items(spark: SparkSession, path: str, schema: str, where: str, required: Sequence[str], count: int, key: str = "id") -> DataFrame:
    """A JSON array, filtered, with required fields and an exact number of items, ordered by id."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).where(where)
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    n, bad = df.agg(F.count(F.lit(1)), F.count_if(missing)).first()
    if bad or n != count:
        raise ValueError(f"{n} items, {bad} incomplete; {count} complete ones are expected")
    return df.orderBy(key)


def write_jsonl(df: DataFrame, path: str, position: str) -> str:
    """Write JSON lines with sorted keys, in order of position, into a folder that must not exist; returns the fingerprint of what stands there."""
    from ..operators.corpus import fingerprint

    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.orderBy(position).select(line.alias("value")).write.mode("errorifexists").text(path)
    written = df.sparkSession.read.text(path)
    return fingerprint(written, F.col("value"), F.get_json_object("value", f"$['{position}']")).first()[0]


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append one batch of answers; with corpus.pending() a broken run is taken up where it stopped."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("append").text(path)


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Append the rows of a batch once, however often it is called with that id; False if the batch stood there already.

    Rows go to a folder of their own under ``path``; the batch counts from the moment its
    entry stands in the ledger, a file that is made only if there is none.  What a
    broken or second attempt has written is in no entry and is never read.
    """
    spark = df.sparkSession
    fs, entry = shared.files(spark, f"{path}/_ledger/{_safe(batch)}.json")
    if fs.exists(entry):
        return False
    folder = f"_data/{_safe(batch)}-{uuid.uuid4().hex}"
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(f"{path}/{folder}")
    return _entered(fs, entry, {"batch": batch, "folder": folder})


def _entered(fs, entry, content: dict) -> bool:
    """Whether this call made the ledger's entry; it is made whole or not at all, and never twice."""
    try:
        stream = fs.createNonRecursive(entry, False, 4096, 1, 1 << 20, None) if fs.exists(entry.getParent()) else fs.create(entry, False)
    except Exception:
        if fs.exists(entry):
            return False
        raise
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    return True


def _safe(batch: str) -> str:
    """A file name for a batch id."""
    if not batch:
        raise ValueError("a batch has an id")
    return "".join(c if c.isascii() and c.isalnum() or c == "-" else f"_{ord(c):x}_" for c in batch)


def ledger(spark: SparkSession, path: str) -> list[dict]:
    """The entries of committed batches, by id."""
    fs, folder = shared.files(spark, f"{path}/_ledger")
    if not fs.exists(folder):
        return []
    rows = spark.read.schema("batch string, folder string").json(f"{path}/_ledger/*.json").where("folder IS NOT NULL").orderBy("batch").collect()
    return [r.asDict() for r in rows]


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches, with their ``batch``."""
    entries = ledger(spark, path)
    if not entries:
        return spark.createDataFrame([], f"{schema}, batch string")
    folders = {e["folder"].rpartition("/")[2]: e["batch"] for e in entries}
    read = spark.read.schema(schema).option("mode", "FAILFAST").json([f"{path}/{e['folder']}" for e in entries])
    names = spark.createDataFrame(list(folders.items()), "_folder string, batch string")
    placed = read.withColumn("_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return placed.join(F.broadcast(names), "_folder").drop("_folder")


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """One JSON document with counts, hashes and provenance, into a folder that must not exist."""
    text = json.dumps(manifest, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
