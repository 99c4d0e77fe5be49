"""Command line: python -m millrace COMMAND ...

Commands that need no data work on their arguments; the others take a folder of
Parquet tables and the tables that may be read.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import compare, corpus, specs
from .plans import analyze, dialect, execute, gate, strict
from .sources import catalog, discover, files


def _print(value: object) -> None:
    print(value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False))


def _check(spark, a) -> int:
    verdict = gate.check(spark, a.sql)
    _print(verdict.__dict__)
    return int(not verdict.allowed)


def _run(spark, a) -> int:
    found = execute.run(spark, a.sql, a.tables.split(","), a.max_rows, a.timeout_ms)
    _print(found.__dict__)
    return int(not found.executed)


def _overlap(spark, a) -> int:
    from .functions.text import question_key

    ours, frozen = (files.read_jsonl(spark, p, "id string, question string") for p in (a.path, a.benchmark))
    bad = [r["id"] for r in corpus.overlapping(ours, question_key(F.col("question")), frozen, question_key(F.col("question"))).select("id").orderBy("id").collect()]
    _print({"overlapping": bad})
    return int(bool(bad))


def _fingerprint(spark, a) -> int:
    lines = spark.read.parquet(a.path)
    _print(corpus.fingerprint(lines, F.col(a.column), F.col(a.position)).first()[0])
    return 0


def _split(spark, a) -> int:
    out = corpus.group_split(spark.read.parquet(a.path), F.col(a.group), a.percent)
    out.write.mode("errorifexists").partitionBy("split").parquet(a.to)
    _print({r["split"]: r["count"] for r in out.groupBy("split").count().collect()})
    return 0


def _compare(spark, a) -> int:
    x, y = (json.loads(Path(p).read_text(encoding="utf-8")) for p in (a.before, a.after))
    _print(compare.compare_reports(x, y))
    return 0


def _specs(spark, a) -> int:
    made = specs.expand(spark, specs.FAMILIES)
    _print({"fingerprint": files.write_jsonl(made.withColumn("position", F.row_number().over(_by("id"))), a.to, "position"), "rows": made.count()})
    return 0


def _strict(spark, a) -> int:
    found = strict.assess(strict.isolated(spark, a.ddl), a.sql, frozenset(strict.typed_tables(a.ddl)))
    _print(found.__dict__)
    return int(not found.valid)


def _discover(spark, a) -> int:
    found = discover.discovered("discovered", {t: spark.table(t) for t in a.tables.split(",")})
    tables = {t.name: {"columns": dict(t.columns), "primary_key": t.primary_key} for t in found.tables.values()}
    _print({"name": found.name, "dialect": found.dialect, "tables": tables, "relationships": [r.__dict__ for r in found.relationships]})
    return 0


def _csv(spark, a) -> int:
    files.read_large_csv(spark, a.path).write.mode("errorifexists").parquet(a.to)
    _print({"rows": spark.read.parquet(a.to).count()})
    return 0


def _append(spark, a) -> int:
    new = files.append_batch(spark.read.parquet(a.path), a.to, a.batch)
    _print({"batch": a.batch, "appended": new, "batches": len(files.ledger(spark, a.to))})
    return 0


def _verdicts(spark, a) -> int:
    judged = corpus.parse_verdicts(spark.read.parquet(a.path), a.column, store=a.store)
    _print({r["verdict"] or "accepted": r["count"] for r in judged.groupBy("verdict").count().collect()})
    return 0


def _pairs(spark, a) -> int:
    rows = spark.read.parquet(a.path)
    found = compare.paired_results(rows, a.pair, a.side, [c for c in rows.columns if c not in (a.pair, a.side)])
    equal = {r["equal"]: r["count"] for r in found.groupBy("equal").count().collect()}
    _print({"equal": equal.get(True, 0), "different": equal.get(False, 0)})
    return int(bool(equal.get(False)))


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # a few thousand specifications


def _said(value) -> int:
    _print(value)
    return 0


#: command -> (arguments, whether it reads tables, what it does).
COMMANDS = {
    "check": (["sql"], False, _check),
    "relations": (["sql"], False, lambda s, a: _said("\n".join(gate.relations(s, a.sql)))),
    "canonical": (["sql"], False, lambda s, a: _said(analyze.canonical(s, a.sql) or "")),
    "complexity": (["sql"], False, lambda s, a: _said(analyze.complexity(s, a.sql))),
    "components": (["sql"], False, lambda s, a: _said(analyze.components(s, a.sql))),
    "assess": (["sql", "ddl"], False, lambda s, a: _said(analyze.assess(s, a.sql, a.ddl).__dict__)),
    "match": (["sql", "other"], False, lambda s, a: 1 - int(analyze.exact_match(s, a.sql, a.other))),
    "rank": (["question", "candidates*"], False, lambda s, a: _said([r.__dict__ for r in analyze.rank_candidates(s, a.question, a.candidates)])),
    "strict": (["sql", "ddl"], False, _strict),
    "postgres": (["sql"], False, lambda s, a: _said(dialect.from_postgres(a.sql))),
    "sqlite": (["sql"], False, lambda s, a: _said(dialect.to_spark(a.sql))),
    "mysql": (["sql"], False, lambda s, a: _said(dialect.from_mysql(a.sql))),
    "compare": (["before", "after"], False, _compare),
    "overlap": (["path", "benchmark"], False, _overlap),
    "fingerprint": (["path", "column", "position"], False, _fingerprint),
    "split": (["path", "group", "to", "percent:int"], False, _split),
    "specs": (["to"], False, _specs),
    "csv": (["path", "to"], False, _csv),
    "append": (["path", "to", "batch"], False, _append),
    "verdicts": (["path", "column", "store"], False, _verdicts),
    "pairs": (["path", "pair", "side"], False, _pairs),
    "render": (["catalog", "pack"], False, None),
    "run": (["sql"], True, _run),
    "profile": ([], True, lambda s, a: _said(catalog.profile(s, a.tables.split(",")))),
    "discover": ([], True, _discover),
    "schema": (["table"], True, lambda s, a: _said(catalog.table_schema(s, a.table, hints=catalog.HINTS))),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, reads, _) in COMMANDS.items():
        p = commands.add_parser(name)
        for argument in arguments:
            word, _, kind = argument.partition(":")
            p.add_argument(word.rstrip("*"), nargs="+" if word.endswith("*") else None, type=int if kind == "int" else str)
        if reads:
            p.add_argument("--data", required=True, help="folder of Parquet tables")
            p.add_argument("--tables", required=True, help="comma-separated allow-list")
            p.add_argument("--max-rows", type=int, default=100)
            p.add_argument("--timeout-ms", type=int, default=5000)
    args = parser.parse_args(argv)
    if args.command == "render":
        _print(catalog.Catalog.load(Path(args.catalog).read_text(encoding="utf-8")).render_pack(args.pack))
        return 0
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    _, reads, work = COMMANDS[args.command]
    if reads:
        catalog.register(spark, args.data, args.tables.split(","))
    return work(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
