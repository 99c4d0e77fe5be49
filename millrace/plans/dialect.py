"""Token-level shims from PostgreSQL and SQLite text to Spark SQL, blind to literals; MySQL text has a module of its own."""

from __future__ import annotations

import re

from . import gate
from .mysql import from_mysql, rewritten  # noqa: F401
from .postgres import from_postgres  # noqa: F401

#: Strftime formats with a column function of their own.
STRFTIME = {"%Y": "year", "%m": "month", "%d": "day", "%H": "hour"}


def _outside_literals(sql: str, rewrite) -> str:
    """Apply ``rewrite`` to the text between single-quoted literals."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", sql)
    return "".join(p if i % 2 else rewrite(p) for i, p in enumerate(parts))


def to_spark(sql: str, ranges: tuple[str, ...] = (), quoted_identifiers: bool = True) -> str:
    """One statement in Spark's dialect.

    Double-quoted names become back-quoted; ``::type`` becomes CAST's ``::`` with
    Spark's names; ``@> ARRAY[..]`` becomes array_contains terms; strftime becomes
    date functions; LOWER/UPPER of the given range columns become their bounds; the
    ``public.`` prefix goes; HAVING without GROUP BY becomes WHERE.
    """
    found = gate.statements(sql)
    if len(found) != 1:
        raise ValueError("exactly one statement is expected")
    text = found[0]
    text = re.sub(r"strftime\(\s*'(%[YmdH])'\s*,\s*([\w.]+)\s*\)", lambda m: f"{STRFTIME[m[1]]}(to_timestamp({m[2]}))", text, flags=re.I)
    text = re.sub(r"([\w.]+)\s*@>\s*ARRAY\s*\[([^\]]*)\]", lambda m: "(" + " AND ".join(f"array_contains({m[1]}, {x.strip()})" for x in m[2].split(",")) + ")", text, flags=re.I)

    def rewrite(part: str) -> str:
        if quoted_identifiers:
            part = re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", part)
        part = re.sub(r"::\s*text\b", "::string", part, flags=re.I)
        part = re.sub(r"\bpublic\.", "", part, flags=re.I)
        for column in ranges:
            part = re.sub(rf"\b(lower|upper)\s*\(\s*((?:\w+\.)?{re.escape(column)})\s*\)", lambda m: f"{m[2]}.{m[1].lower()}", part, flags=re.I)
        return part

    text = _outside_literals(text, rewrite)
    if re.search(r"\bhaving\b", text, re.I) and not re.search(r"\bgroup\s+by\b", text, re.I):
        text = _outside_literals(text, lambda p: re.sub(r"\bhaving\b", "AND" if re.search(r"\bwhere\b", text, re.I) else "WHERE", p, flags=re.I))
    return text


def apply_rules(identifier: str, sql: str, rules: dict[str, list[tuple[str, str]]]) -> str:
    """Reviewed rewrites of single queries: pairs of pattern and replacement by query id."""
    for pattern, replacement in rules.get(identifier, []):
        sql = re.sub(pattern, replacement, sql)
    return sql
