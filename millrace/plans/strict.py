"""Strict assessment of a query against a DDL: Catalyst resolves every name in an isolated session.

The DDL's tables become empty typed views of a session that shares nothing but the
Spark application, so a column must belong to a table that the query reads, in its
scope, with a type its use allows, and nothing of the caller's session is seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import analyze, gate

#: Types of common dialects and those of Spark.
TYPES = {
    "int": "bigint", "integer": "bigint", "smallint": "bigint", "tinyint": "bigint", "mediumint": "bigint", "bigint": "bigint", "serial": "bigint", "bigserial": "bigint", "year": "bigint",
    "real": "double", "float": "double", "double": "double", "numeric": "decimal(38,10)", "decimal": "decimal(38,10)", "money": "decimal(38,10)",
    "bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "timestamptz": "timestamp", "time": "string",
    "blob": "binary", "bytea": "binary", "binary": "binary", "varbinary": "binary", "interval": "interval day to second",
}
#: Words that begin a constraint instead of a column.
CONSTRAINTS = frozenset({"primary", "foreign", "unique", "constraint", "check", "key", "index", "exclude"})


def typed_tables(ddl: str) -> dict[str, list[tuple[str, str]]]:
    """Columns and Spark types of every CREATE TABLE, by lower-cased table name without schema; what has no known type is a string."""
    out: dict[str, list[tuple[str, str]]] = {}
    for statement in gate.statements(ddl):
        words = [t for t in gate.lex(statement) if not t.isspace()]
        low = [w.lower() for w in words]
        if low[:1] != ["create"] or "table" not in low or "(" not in low:
            continue
        opened = low.index("(")
        out[analyze._bare(words[opened - 1])] = [(analyze._bare(c[0]), _type([x.lower() for x in c[1:]])) for c in _columns(words[opened + 1 :]) if c[0].lower() not in CONSTRAINTS]
    return out


def _columns(words: list[str]) -> Iterator[list[str]]:
    """The parts of a bracket between commas, up to its end."""
    depth, now = 1, []
    for w in words:
        depth += (w == "(") - (w == ")")
        if not depth:
            break
        if w == "," and depth == 1:
            if now:
                yield now
            now = []
        else:
            now.append(w)
    if now:
        yield now


def _type(words: list[str]) -> str:
    name = words[0] if words else ""
    sizes = re.match(r"\((\d+)(?:,(\d+))?\)", "".join(words[1:]))
    kind = TYPES.get(name, "string")
    if kind.startswith("decimal") and sizes and int(sizes[1]) <= 38:
        kind = f"decimal({sizes[1]},{sizes[2] or 0})"
    return f"array<{kind}>" if "[" in words[1:6] else kind


def isolated(spark: SparkSession, ddl: str) -> SparkSession:
    """A session of its own that has the tables of a DDL, empty, and no other view."""
    session = spark.newSession()
    for table, columns in typed_tables(ddl).items():
        session.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns)).createOrReplaceTempView(table)
    return session


@dataclass(frozen=True)
class Strict:
    """``rule`` is None for a sound query; else refused, out_of_scope, or the analyser's condition."""

    valid: bool
    rule: str | None = None


def assess(session: SparkSession, sql: str, tables: frozenset[str] | set[str]) -> Strict:
    """Policy, scope and resolution of one query in an isolated session."""
    verdict = gate.check(session, sql)
    if not verdict.allowed:
        return Strict(False, "refused" if verdict.reason != "unparsable" else "unparsable")
    if gate.out_of_scope(session, verdict.normalized_sql, tables):
        return Strict(False, "out_of_scope")
    try:
        session.sql(verdict.normalized_sql).schema  # noqa: B018  analysed, never run
    except Exception as e:
        condition = e.getCondition() if hasattr(e, "getCondition") else None
        return Strict(False, (condition or "unresolved").partition(".")[0].lower())
    return Strict(True)


def assessed(df: DataFrame, column: str, ddl: str, store: str | None = None) -> DataFrame:
    """``df`` with (valid, rule) of every distinct SQL text against one DDL."""
    session, tables = isolated(df.sparkSession, ddl), frozenset(typed_tables(ddl))

    def judge(sql: str) -> tuple:
        found = assess(session, sql, tables)
        return found.valid, found.rule

    return analyze.with_analysis(df, column, judge, "valid boolean, rule string", store=store)
