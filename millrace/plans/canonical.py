"""Canonical form of a SQL text: a digest over Catalyst's parsed tree.

Every node counts with its class, its typed literals, its names and its children in
order, so the form is blind to layout, comments and the case of keywords and to
nothing else.  Numbers that a parse hands out (expression ids) are left out by their
field, never by a pattern over text.  Where the tree does not carry all that was
written (rows of VALUES, index lists of grouping sets, names with a comma inside),
the tokens of the text join the digest: such texts match by token, never falsely.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import SparkSession

from . import gate

#: Fields that number a parse, fields that a parsed plan leaves empty, and the word without which a field has its default.
NUMBERS = frozenset({"exprId", "jvmId", "resultId", "planId"})
UNUSED = frozenset({"options", "evalContext", "metadata", "hint"})
DEFAULTS = {"escapeChar": "escape", "evalMode": "try_cast"}


def tree(plan, words: list[str]) -> tuple[list, bool]:
    """The plan's nodes without numbers, and whether they carry all that the ``words`` of the text say."""
    whole = True
    known = UNUSED | {k for k, word in DEFAULTS.items() if word not in words}

    def told(value):
        nonlocal whole
        if isinstance(value, list):
            return [told(v) for v in value]
        if isinstance(value, dict):
            whole = whole and not any(v is None and k not in known for k, v in value.items())
            return {k: told(v) for k, v in value.items() if k not in NUMBERS}
        return value

    return told(json.loads(plan.toJSON())), whole


def tokens(sql: str) -> list[str]:
    """Tokens without layout and comments; words outside quotes lower-cased."""
    found = [t for t in gate.lex(sql) if not t.isspace() and not t.startswith(("--", "/*"))]
    return [t.lower() if re.match(r"[A-Za-z_]", t) else t for t in found]


def form(spark: SparkSession, sql: str) -> str | None:
    """Hex digest of one SELECT; None if the text is refused or does not parse."""
    text = gate.check_text(sql)
    if not text.allowed:
        return None
    words = tokens(text.normalized_sql)
    try:
        nodes, whole = tree(gate.parse(spark, text.normalized_sql), words)
    except Exception:  # the parser's errors come as several Java classes
        return None
    # lists of names are written without quotes: [a, b] may be one name with a comma
    odd = any(t.startswith("`") and re.search(r"[\[\],]", t) for t in words) or ["with", "("] in [words[i : i + 2] for i in range(len(words) - 1)]
    said = [nodes] if whole and not odd else [nodes, words]
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()
