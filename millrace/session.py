"""Question sessions: moves in a table, facts in a log, and prompts made of sections.

A session is the fold of its events over MOVES; nothing else changes its stage.
The author stays outside: any callable from messages to answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import SparkSession

from .plans import analyze, execute, gate
from .sources.catalog import compile_context


class Stage(StrEnum):
    """The stages a session reports."""

    AWAITING_SCHEMA = "awaiting_schema"
    AWAITING_SQL = "awaiting_sql"
    AWAITING_EXECUTION = "awaiting_execution"
    REPAIRING = "repairing"
    FINALIZED = "finalized"
    BLOCKED = "blocked"


#: Roles, what each may call, and the tools' argument schemas.
ROLES = {
    "orchestrator": (),
    "schema_specialist": ("get_database_profile", "get_table_schema"),
    "sql_author": (),
    "policy_guardian": (),
    "sql_repairer": (),
    "finalizer": (),
}
TOOLS = {
    "get_database_profile": {"type": "object", "properties": {}, "additionalProperties": False},
    "get_table_schema": {"type": "object", "properties": {"table_name": {"type": "string", "minLength": 1}}, "required": ["table_name"], "additionalProperties": False},
    "execute_readonly_sql": {
        "type": "object",
        "properties": {"sql": {"type": "string", "minLength": 1}, "max_rows": {"type": "integer", "minimum": 1, "maximum": 1000}},
        "required": ["sql", "max_rows"],
        "additionalProperties": False,
    },
}

#: Where an event leads from each stage in which it may happen; MEND is REPAIRING while repairs are left, else BLOCKED.
MEND = "mend"
OPEN = (Stage.AWAITING_SQL, Stage.REPAIRING)
MOVES: dict[tuple[Stage, str], Stage | str] = {
    **dict.fromkeys([(s, "schemas") for s in (Stage.AWAITING_SCHEMA, Stage.REPAIRING)], Stage.AWAITING_SQL),
    **dict.fromkeys([(s, "accepted") for s in OPEN], Stage.AWAITING_EXECUTION),
    **dict.fromkeys([(s, "refused") for s in OPEN], Stage.BLOCKED),  # policy is never repaired
    **dict.fromkeys([(s, "invalid") for s in OPEN], MEND),
    **dict.fromkeys([(s, "closed") for s in (Stage.AWAITING_SCHEMA, *OPEN)], Stage.FINALIZED),
    (Stage.AWAITING_EXECUTION, "ran"): Stage.FINALIZED,
    (Stage.AWAITING_EXECUTION, "failed"): MEND,
}


@dataclass
class Session:
    question: str
    max_repairs: int = 2
    stage: Stage = Stage.AWAITING_SCHEMA
    log: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.question = (self.question or "").strip()
        if not self.question or self.max_repairs < 0:
            raise ValueError("a session needs a question, and repairs of zero or more")

    @property
    def repairs(self) -> int:
        """Repairs begun: events that led back to the author."""
        return sum(event in {"invalid", "failed"} for event, _ in self.log) - (self.stage == Stage.BLOCKED and self.log[-1][0] in {"invalid", "failed"})

    @property
    def reason(self) -> str | None:
        """What stands against the last query, if anything does."""
        if not self.log or self.log[-1][0] in {"schemas", "accepted", "ran"}:
            return None
        return "repair limit reached" if self.stage == Stage.BLOCKED and self.log[-1][0] != "refused" else self.log[-1][1]

    def note(self, event: str, fact: str) -> Stage:
        """Enter an event; raises where the table has no such move."""
        if not fact.strip():
            raise ValueError(f"{event}: nothing said")
        to = MOVES.get((self.stage, event))
        if to is None:
            raise RuntimeError(f"{event} cannot happen while {self.stage}")
        if to == MEND:
            to = Stage.REPAIRING if self.repairs < self.max_repairs else Stage.BLOCKED
        self.log.append((event, fact.strip()))
        self.stage = to
        return to


SYSTEM = "Escreva uma única consulta SQL de leitura que responda à pergunta, usando apenas as tabelas e colunas mostradas. Devolva só o SQL."


def rendered(sections: Sequence[tuple[str, str | None]]) -> str:
    """Sections with a body, each under its title."""
    return "\n\n".join(f"### {title}\n{body.strip()}" for title, body in sections if body and body.strip())


def chat(system: str, user: str) -> list[dict[str, str]]:
    return [dict(zip(("role", "content"), pair, strict=True)) for pair in (("system", system), ("user", user))]


def author_messages(question: str, ddl: str, error: str | None = None, previous: str | None = None) -> list[dict[str, str]]:
    """The author's prompt; a repair also shows the former query and its error."""
    needed = {"question": question, "schema": ddl, **({"former query": previous} if error else {})}
    if lacking := [name for name, body in needed.items() if not (body or "").strip()]:
        raise ValueError(f"missing: {', '.join(lacking)}")
    return chat(SYSTEM, rendered([("Esquema", ddl), ("Consulta recusada", previous if error else None), ("Motivo", error), ("Pergunta", question)]))


def pack_messages(question: str, catalog, pack: str, system: str, template: str) -> list[dict[str, str]]:
    """A template with {dialect}, {schema} and {question}, filled from a relation pack."""
    asked = question.strip()
    if not asked:
        raise ValueError("missing: question")
    return chat(system, template.format_map({"dialect": catalog.dialect, "schema": catalog.render_pack(pack), "question": asked}))


def distinct_candidates(outputs: Iterable[str], count: int) -> list[str]:
    """Cleaned answers in order, once each, at most ``count`` (1..5)."""
    if count not in range(1, 6):
        raise ValueError("count must be in 1..5")
    cleaned = dict.fromkeys(filter(None, map(analyze.strip_thinking, outputs)))
    if not cleaned:
        raise RuntimeError("the author gave no candidate")
    return [*cleaned][:count]


@dataclass(frozen=True)
class Offer:
    """A candidate and what speaks against it."""

    sql: str
    problem: str | None  # unparsable, or out of scope
    allowed: bool

    @property
    def grade(self) -> int:
        return 0 if self.problem else 1 + self.allowed


def offers(spark: SparkSession, question: str, candidates: Sequence[str], tables: Iterable[str]) -> list[Offer]:
    """The candidates, best first: allowed and in scope, then in scope, then the rest; by cue score within a grade."""
    found = []
    for sql in (r.sql for r in analyze.rank_candidates(spark, question, candidates)):
        try:
            outside = gate.out_of_scope(spark, sql, tables)
            problem = f"out_of_scope: {', '.join(outside)}" if outside else None
        except Exception as e:  # the parser's errors come as several Java classes
            problem = gate.sanitize(e)
        found.append(Offer(sql, problem, problem is None and gate.check(spark, sql).allowed))
    return sorted(found, key=lambda o: -o.grade)


def answer(spark: SparkSession, question: str, schemas: dict[str, str], author: Callable[[list[dict]], Iterable[str]], count: int = 3, max_rows: int = 100, max_repairs: int = 2, timeout_ms: int = 5_000) -> tuple[Session, execute.Execution | None]:
    """Ask the author until a query has run, policy refuses one, or repairs are used up."""
    by_name = {name.lower(): text for name, text in schemas.items()}
    session, result, former = Session(question, max_repairs), None, None
    session.note("schemas", "\n\n".join(schemas.values()))
    ddl = compile_context(schemas, by_name.__getitem__).ddl
    while session.stage in OPEN:
        messages = author_messages(session.question, ddl, session.reason, former)
        best = offers(spark, session.question, distinct_candidates(author(messages), count), schemas)[0]
        former = best.sql
        if best.problem:
            session.note("invalid", best.problem)
        elif not best.allowed:
            session.note("refused", gate.check(spark, best.sql).reason or "refused")
        else:
            session.note("accepted", best.sql)
            result = execute.run(spark, best.sql, schemas, max_rows, timeout_ms)
            session.note("failed", result.error) if result.error else session.note("ran", best.sql)
    return session, result
