"""Governed execution: gate, scope, row cap, timeout, sanitised errors."""

from __future__ import annotations

import logging
import math
import re
import threading
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame, SparkSession

from . import gate


@dataclass(frozen=True)
class Execution:
    allowed: bool
    executed: bool
    columns: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()
    truncated: bool = False
    error: str | None = None
    relations: tuple[str, ...] = field(default=())
    normalized_sql: str | None = None


def capped(df: DataFrame, max_rows: int) -> DataFrame:
    """The first rows of a plan; Catalyst makes it a top-k where the plan is sorted."""
    return df.limit(max_rows)


def scan_bytes(df: DataFrame) -> int:
    """What the scans of the optimised plan are estimated to read."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


@dataclass(frozen=True)
class Budget:
    """Work that a run may do: tasks begun, records read by scans and shuffles, and seconds that tasks have run, added up over all tasks."""

    tasks: int | None = None
    records: int | None = None
    task_seconds: float | None = None


class Work:
    """What the jobs of a tag have done so far, added up from Spark's own counts."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.sc, self.tag = spark.sparkContext._jsc.sc(), tag
        self.tasks, self.records, self.task_seconds = 0, 0, 0.0
        self.seen = time.monotonic()

    def look(self) -> None:
        """Read tasks and records of every stage; time is added for the tasks that run now."""
        now = time.monotonic()
        elapsed, self.seen = now - self.seen, now
        store, tasks, records, active = self.sc.statusStore(), 0, 0, 0
        stages = set()
        for job in self.sc.statusTracker().getJobIdsForTag(self.tag):
            ids = store.job(job).stageIds()
            stages |= {ids.apply(i) for i in range(ids.size())}
        for stage in stages:
            try:
                data = store.lastStageAttempt(stage)
            except Exception:  # not begun yet, or skipped
                continue
            active += data.numActiveTasks()
            tasks += data.numActiveTasks() + data.numCompleteTasks() + data.numFailedTasks()
            records += data.inputRecords() + data.shuffleReadRecords()
        self.tasks, self.records, self.task_seconds = tasks, records, self.task_seconds + elapsed * active

    def beyond(self, budget: Budget) -> str | None:
        """The first part of a budget that is used up."""
        for name in ("tasks", "records", "task_seconds"):
            most = getattr(budget, name)
            if most is not None and getattr(self, name) > most:
                return f"work_budget: {getattr(self, name):.0f} {name} of {most:g}"
        return None


_RUNNING = threading.local()


def _not_returned(record: logging.LogRecord) -> bool:
    """False for the record that PySpark makes of an error, with stack and plan, where run() returns that error."""
    return not getattr(_RUNNING, "now", False)


class Judge:
    """The gate's verdict, the relations and those outside ``allowed`` of many texts, found once for each shape (gate.shape): all three follow from the parsed tree without its plain values.

    So does a column without a match, in a text without brackets (no calls, no queries in it)
    and without BY (no ordinals): there, names and types decide.  So does an error that a text
    meets before it reads its value (compared()), while its table stays as it is.  All else is
    for the engine to say of each text.  At most ``most`` shapes are kept.
    """

    #: SELECT of names from one table, where arithmetic without calls is compared with a whole number at the end.
    COMPARED = re.compile(r"(select\s([\w\s,.]+?)\sfrom\s+(\w+)\s+where\s([\w\s.()+*/%-]+?)(?:<=|>=|<>|=|<|>))\s*[0-9]{1,9}", re.I)
    VALUE_READ = "raise_error('a value was read')"

    def __init__(self, spark: SparkSession, allowed: Iterable[str], most: int = 10_000) -> None:
        self.spark, self.allowed, self.most = spark, tuple(allowed), most
        self.known: dict[str, tuple] = {}
        self.unresolved: dict[str, str] = {}
        self.before_value: dict[str, str | None] = {}

    @staticmethod
    def _named(sql: str) -> str | None:
        """The shape of a text whose columns are found by names and types alone."""
        tokens = {t.lower() for t in gate.lex(sql)}
        return None if tokens & {"(", "[", "by"} else gate.shape(sql)

    @classmethod
    def _compared(cls, sql: str) -> tuple[str, str, str] | None:
        """(the text up to its value, table, left side) of a text of the form COMPARED: no AND, CASE or call lets the plan or a row pass over the left side for some values."""
        found = cls.COMPARED.fullmatch(sql)
        if not found or {"select", "from"} & set(found[2].lower().split()):
            return None
        left = found[4]
        return None if re.search(r"\w\s*\(|\w\s+\w", left) else (found[1], found[3], left)

    def compared(self, sql: str, error: str) -> None:
        """Keep the error for all texts that differ from this one in the value alone, if the engine says the same where reading the value is an error of its own: on its first row, the left side fails.

        Only over a table that stands in the plan as itself, and only for types that are compared
        with whole numbers as they are: Catalyst then leaves the left side as it is for any value.
        """
        form = self._compared(sql)
        if not form or form[0] in self.before_value or len(self.before_value) >= self.most:
            return
        head, table, left = form
        same = None
        try:
            plan = self.spark.table(table)._jdf.queryExecution().optimizedPlan()
            kind = self.spark.sql(f"SELECT {left} AS a FROM {table}").schema["a"].dataType.simpleString()
            if not plan.children().size() and kind in {"int", "bigint", "double"}:
                capped(self.spark.sql(f"{head} CAST({self.VALUE_READ} AS INT)"), 1).collect()
        except Exception as e:
            same = error if gate.sanitize(e) == error else None
        self.before_value[head] = same

    def failed(self, sql: str) -> str | None:
        """What a text that fails alike said."""
        if self.before_value and (form := self._compared(sql)) and (error := self.before_value.get(form[0])):
            return error
        return self.unresolved.get(self._named(sql)) if self.unresolved else None

    def learn(self, sql: str, error: str) -> None:
        if error.startswith("UNRESOLVED_COLUMN"):
            if (shape := self._named(sql)) and len(self.unresolved) < self.most:
                self.unresolved[shape] = error
        else:
            self.compared(sql, error)

    def __call__(self, sql: str) -> tuple[gate.PolicyResult, tuple[str, ...], tuple[str, ...]]:
        """(verdict, relations, those out of scope); the last two are empty if the text is refused."""
        first = gate.check_text(sql)
        if not first.allowed:
            return first, (), ()
        shape = gate.shape(first.normalized_sql)
        found = self.known.get(shape)
        if found is None:
            verdict = gate.check(self.spark, first.normalized_sql)
            found = (verdict.reason, (), ())
            if verdict.allowed:
                found = (None, gate.relations(self.spark, first.normalized_sql), gate.out_of_scope(self.spark, first.normalized_sql, self.allowed))
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[shape] = found
        reason, used, outside = found
        return gate.PolicyResult(reason is None, reason, first.normalized_sql), used, outside


def run(
    spark: SparkSession,
    sql: str,
    allowed: Iterable[str],
    max_rows: int = 100,
    timeout_ms: int | None = 5_000,
    args: dict | None = None,
    max_bytes: int | None = None,
    budget: Budget | None = None,
    judge: Judge | None = None,
) -> Execution:
    """Gate a query and run it over the tables ``allowed``: at most ``max_rows`` rows, cancelled after ``timeout_ms`` (None: never).

    ``truncated`` is exact: one row more than asked for is fetched.  Results of
    EXPLAIN are capped as well.  ``max_bytes`` keeps a plan whose scans are estimated to
    read more from running; ``budget`` is held against the work of the run's own jobs
    while they run, and cancels them beyond it.  A ``judge`` made for the same tables
    spares many texts of few shapes the parsing; its tables take the place of ``allowed``.
    """
    if not 1 <= max_rows <= 1000:
        raise ValueError("max_rows must be in 1..1000")
    if timeout_ms is not None and not 100 <= timeout_ms <= 30_000:
        raise ValueError("timeout_ms must be in 100..30000")
    verdict, used, outside = (judge or Judge(spark, allowed))(sql)
    if not verdict.allowed:
        return Execution(False, False, error=verdict.reason, normalized_sql=verdict.normalized_sql)
    text = verdict.normalized_sql
    if outside:
        return Execution(True, False, error=f"out_of_scope: {', '.join(outside)}", relations=used, normalized_sql=text)
    if judge and not args and (error := judge.failed(text)):
        return Execution(True, False, error=error, relations=used, normalized_sql=text)
    tag, sc = f"millrace-{uuid.uuid4().hex}", spark.sparkContext
    done, deadline, stopped = threading.Event(), math.inf if timeout_ms is None else time.monotonic() + timeout_ms / 1000, []

    def watch() -> None:
        # again and again: at the deadline the query may still be planned, its jobs not yet begun
        work = Work(spark, tag) if budget else None
        while not done.wait(0.1 if work else max(0.2, min(60.0, deadline - time.monotonic()))):
            if work and not stopped:
                work.look()
                if reason := work.beyond(budget):
                    stopped.append(reason)
            if stopped or time.monotonic() >= deadline:
                sc.cancelJobsWithTag(tag)

    watchdog = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watchdog.start()
    PySparkLogger.getLogger("SQLQueryContextLogger").addFilter(_not_returned)  # once: the same filter is not added again
    _RUNNING.now = True
    try:
        df = spark.sql(text, args=args) if args else spark.sql(text)
        if max_bytes is not None and (size := scan_bytes(df)) > max_bytes:
            return Execution(True, False, error=f"work_budget: {size} bytes", relations=used, normalized_sql=text)
        found = capped(df, max_rows + 1).collect()
    except Exception as e:  # analysis, runtime and cancellation errors alike
        error = stopped[0] if stopped else gate.sanitize(e)
        if judge and not args:
            judge.learn(text, error)
        return Execution(True, False, error=error, relations=used, normalized_sql=text)
    finally:
        _RUNNING.now = False
        done.set()
        sc.removeJobTag(tag)
    return Execution(True, True, tuple(df.columns), tuple(tuple(r) for r in found[:max_rows]), len(found) > max_rows, None, used, text)


def validate_and_execute(spark: SparkSession, sql: str, catalog, pack: str, max_rows: int = 100, timeout_ms: int = 5_000) -> Execution:
    """run() within the tables of one relation pack of a catalog."""
    return run(spark, sql, catalog.pack(pack).tables, max_rows, timeout_ms)
