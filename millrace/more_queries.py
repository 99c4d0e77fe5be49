"""Queries of the operators that work on SQL texts, answers, samples and catalogs, over rows made from the tables, with the SQL that says what must come out."""

from __future__ import annotations

import datetime
import itertools
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import question_key
from .operators import collate, compare, corpus, creative, sketch, specs
from .plans import analyze, dialect, execute, gate
from .sources import catalog


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- a view over a query, and the catalog ------------------------------------------------------


def view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over a view that is itself a query."""
    catalog.register(spark, sf_dir, ["lineitem"])
    made = "SELECT l_returnflag AS flag, count(*) AS lines, CAST(round(sum(CAST(l_extendedprice AS decimal(18, 4))), 2) AS double) AS sales FROM lineitem GROUP BY l_returnflag"
    if gate.out_of_scope(spark, made, ["lineitem"]) or not gate.check(spark, made).allowed:
        raise PermissionError("view_scan")
    asked = "SELECT flag, lines, sales FROM sales_by_flag WHERE lines > 0 ORDER BY sales DESC, flag"
    if gate.out_of_scope(spark, asked, ["sales_by_flag"]) or not gate.check(spark, asked).allowed:
        raise PermissionError("view_scan")
    spark.sql(made).createOrReplaceTempView("sales_by_flag")
    try:
        return spark.sql(asked)
    finally:  # the plan holds the view's; nothing stays behind in the session
        spark.catalog.dropTempView("sales_by_flag")


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["region", "nation", "customer", "orders", "lineitem"]
    catalog.register(spark, sf_dir, names)
    return catalog.columns_of(spark, names).select("table_name", F.col("ordinal").alias("place"), "column_name")


def catalog_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys, null keys and orphans of a catalog over the tables, one of them cut down."""
    made = catalog.Catalog(
        "shop",
        "spark",
        {"orders": catalog.Table("orders", (("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT")), ("o_orderkey",)), "customer": catalog.Table("customer", (("c_custkey", "BIGINT"),), ("c_custkey",))},
        (catalog.Relationship("orders", ("o_custkey",), "customer", ("c_custkey",)),),
    )
    made.validate()
    tables = {"orders": _table(spark, sf_dir, "orders"), "customer": _table(spark, sf_dir, "customer").where("c_nationkey <> 3")}
    return made.integrity(tables)


# --- SQL texts ---------------------------------------------------------------------------------

#: Shapes of SQL text, filled with a nation's name and key.
SHAPES = (
    "SELECT count(*) FROM customer WHERE c_nationkey = {key}",
    "SELECT '{name}; -- x' AS t, c_name FROM customer WHERE c_acctbal > {key} ORDER BY c_name LIMIT {key}1",
    "{verb} INTO nation SELECT * FROM nation WHERE n_nationkey = {key}",
    "WITH x AS (SELECT {key} AS k) {verb} INTO nation SELECT * FROM x",
    "SELECT reflect('java.lang.System', '{name}')",
    "SELECT {key}; SELECT '{name}'",
    "SELECT n_name, sum(c_acctbal) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey = {key} GROUP BY n_name",
    "SELECT * FROM csv.`/data/{name}`",
    "SELEC {key}",
)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, shape, sql): every shape for every nation."""
    verb = F.element_at(F.array(F.lit("INSERT"), F.lit("MERGE"), F.lit("insert")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    shaped = _table(spark, sf_dir, "nation").select("*", F.posexplode(F.array(*[F.lit(x) for x in SHAPES])).alias("shape", "template"))
    return shaped.select(F.col("n_nationkey").alias("nation"), "shape", corpus.fill(F.col("template"), {"key": F.col("n_nationkey"), "name": F.col("n_name"), "verb": verb}).alias("sql"))


def sql_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    def judge(sql: str) -> tuple:
        v = gate.check(spark, sql)
        return v.allowed, v.reason

    return analyze.with_analysis(_texts(spark, sf_dir), "sql", judge, "allowed boolean, reason string").select("nation", "shape", "allowed", "reason")


def sql_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _texts(spark, sf_dir).where("shape in (0, 1, 6, 8)")
    return analyze.with_analysis(some, "sql", lambda t: (analyze.complexity(spark, t),), "bucket string").select("nation", "shape", "bucket")


def sql_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parts(sql: str) -> tuple:
        c = analyze.components(spark, sql)
        return ",".join(c["relations"]), ",".join(c["aggregates"]), len(c["joins"]), len(c["group_by"]), len(c["order_by"]), c["limit"], len(c["projection"])

    some = _texts(spark, sf_dir).where("shape in (0, 1, 6)")
    out = analyze.with_analysis(some, "sql", parts, "relations string, aggregates string, joins int, group_by int, order_by int, limit_value string, projection int")
    return out.drop("sql")


def sql_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse, policy and references against the DDL of one table."""
    ddl = "CREATE TABLE customer (c_custkey BIGINT, c_name TEXT, c_acctbal REAL, c_nationkey BIGINT);"

    def judge(sql: str) -> tuple:
        a = analyze.assess(spark, sql, ddl)
        return a.parses, a.policy_allowed, a.schema_references_valid

    some = _texts(spark, sf_dir).where("shape in (0, 1, 2, 6, 8)")
    return analyze.with_analysis(some, "sql", judge, "parses boolean, policy boolean, valid boolean").drop("sql")


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of candidates for questions asked of every nation; the question's cue depends on the row."""
    nation = _table(spark, sf_dir, "nation")
    asked = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Quantos clientes tem "), "n_name", F.lit("?"))).otherwise(F.concat(F.lit("Liste clientes de "), "n_name", F.lit(" com os maiores saldos")))
    texts = F.array(F.lit("SELECT count(*) FROM customer"), F.lit("SELECT c_name FROM customer ORDER BY c_acctbal DESC"), F.lit("SELEC"))
    rows = nation.select(F.col("n_nationkey").alias("nation"), asked.alias("question"), F.posexplode(texts).alias("number", "candidate"))
    rows = rows.withColumn("both", F.concat_ws("\x1f", "question", "candidate"))
    out = analyze.with_analysis(rows, "both", lambda t: (analyze.score_candidate(spark, *t.split("\x1f")).score,), "score int")
    return out.select("nation", "number", "score")


def canonical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose canonical SQL stands in a frozen benchmark that is laid out otherwise."""
    nation = _table(spark, sf_dir, "nation")
    ours = nation.select(F.col("n_nationkey").alias("nation"), corpus.fill(F.lit("SELECT c_name FROM customer WHERE c_nationkey = {k}"), {"k": F.col("n_nationkey")}).alias("sql"))
    frozen = nation.where("n_regionkey = 2").select(corpus.fill(F.lit("select\n  c_name from customer\nwhere c_nationkey = {k}"), {"k": F.col("n_nationkey")}).alias("sql"))
    one = analyze.with_analysis(ours, "sql", lambda t: (analyze.canonical(spark, t),), "form string")
    two = analyze.with_analysis(frozen, "sql", lambda t: (analyze.canonical(spark, t),), "form string")
    return corpus.overlapping(one, F.col("form"), two, F.col("form")).select("nation")


SPEC_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "part", "events")
#: Columns that specifications hold against one another by NOT IN.
SPEC_KEYS = {"orders": ("o_orderkey",), "lineitem": ("l_orderkey",)}


def spec_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications of all families, run: each one's rows and first value, eight queries at a time; what fails so, for want of memory, runs again alone."""
    own = catalog.sized_session(spark)
    catalog.register_held(own, sf_dir, [t for t in SPEC_TABLES if t not in SPEC_KEYS])
    catalog.register_known(own, sf_dir, SPEC_KEYS)
    made = specs.expand(spark, specs.FAMILIES)
    alone = threading.Lock()  # the other threads go on; those that failed wait for one another

    def ran(sql: str) -> tuple:
        found = execute.run(own, sql, SPEC_TABLES, 1000, None)
        if found.error:
            with alone:
                found = execute.run(own, sql, SPEC_TABLES, 1000, None)
        if found.error:
            return None, found.error, None
        first = found.rows[0][0] if found.rows else None
        number = first is not None and not isinstance(first, (str, datetime.date))
        return len(found.rows), None if number or first is None else str(first), round(float(first), 2) if number else None

    return analyze.with_analysis(made, "sql", ran, "found int, text string, amount double", lambda t: analyze.canonical(spark, t), threads=8).select("id", "family", "found", "text", "amount")


def _specs_sql() -> str:
    """The SQL of every specification, expanded here without Spark: rows (at most 1,000) and the first value."""
    parts = []
    for f in specs.FAMILIES:
        for i, values in enumerate(itertools.product(*f.grid.values()), 1):
            sql = f.sql
            for name, value in zip(f.grid, values, strict=True):
                sql = sql.replace("{" + name + "}", str(value))
            ids = ", ".join(f"('{f.name}-{i:03d}-p{p}')" for p in range(1, len(f.questions) + 1))
            parts.append(f"SELECT id, '{f.name}' AS family, (SELECT least(1000, count(*)) FROM ({sql}))::INTEGER AS found, (SELECT a::VARCHAR FROM ({sql}) AS t(a) LIMIT 1) AS v FROM (VALUES {ids}) t(id)")
    every = "\nUNION ALL ".join(parts)
    return f"SELECT id, family, found, CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END AS text, round(try_cast(v AS DOUBLE), 2) AS amount FROM ({every})"


def other_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question in three dialects, rewritten, gated and run: orders by year."""
    texts = {
        "sqlite": "SELECT strftime('%Y', o_orderdate) AS y, count(*) AS n FROM orders GROUP BY strftime('%Y', o_orderdate)",
        "postgres": "SELECT date_part('year', \"o_orderdate\") AS y, count(*) AS n FROM public.orders WHERE o_orderstatus::text <> 'x' GROUP BY date_part('year', \"o_orderdate\")",
        "mysql": "SELECT DATE_FORMAT(o_orderdate, '%Y') AS y, count(IFNULL(o_totalprice, 0)) AS n FROM orders WHERE o_orderstatus <> \"x\" GROUP BY DATE_FORMAT(o_orderdate, '%Y') LIMIT 0, 100",
    }
    catalog.register(spark, sf_dir, ["orders"])
    out = None
    for name, text in texts.items():
        sql = dialect.from_mysql(text) if name == "mysql" else dialect.to_spark(text)
        if not gate.check(spark, sql).allowed or gate.out_of_scope(spark, sql, ["orders"]):
            raise PermissionError(name)
        part = spark.sql(sql).select(F.lit(name).alias("dialect"), F.col("y").cast("string").alias("y"), "n")
        out = part if out is None else out.unionByName(part)
    return out


# --- sketches ----------------------------------------------------------------------------------


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _sketches

    return _sketches(spark, sf_dir)


def sketch_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir).where("number = 0").select(F.col("c_nationkey").alias("nation"), sketch.render_schema(F.col("table")).alias("ddl"))


def sketch_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _drawn(spark, sf_dir).withColumn("b", sketch.brief(F.col("table"), F.col("sketch"), F.size(sketch.run_sketch(F.col("table"), F.col("sketch")))))
    terms = F.array_join(F.transform("b.conditions", lambda c: F.concat_ws(" ", c["column"], c["operator"], c["value"])), " AND ")
    return made.select(F.col("c_nationkey").alias("nation"), "number", "b.result_column", "b.aggregation", terms.alias("conditions"), F.array_join("b.literal_values", "|").alias("literal_values"), "b.answer_shape", F.col("b.reference_row_count").cast("bigint").alias("rows"))


def sketch_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and sketches as Python literals made from rows, read back and run: the mean order of a customer's segment."""
    customers = _table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("r"))
    rows = F.array_join(F.transform("r", lambda x: F.concat(F.lit("array(["), x["c_custkey"].cast("string"), F.lit(", "), x["c_acctbal"].cast("string"), F.lit("], dtype=object)"))), ", ")
    table = F.concat(F.lit("{'header': array(['Key', 'key'], dtype=object), 'types': ('text', 'real'), 'rows': ["), rows, F.lit("], 'id': '"), "c_mktsegment", F.lit("', 'name': None}"))
    drawn = F.lit("{'sel': 1, 'agg': 3, 'conds': {'column_index': [1], 'operator_index': [1], 'condition': ['0']}}")
    read = sketch.parsed(customers.select("c_mktsegment", table.alias("t"), drawn.alias("s")), "t", "s", "c_mktsegment")
    return read.select(F.col("c_mktsegment").alias("segment"), F.array_join("table.headers", ",").alias("headers"), F.element_at(sketch.run_sketch(F.col("table"), F.col("sketch")), 1).alias("positive"), "error")


# --- samples, identifiers, comparisons -----------------------------------------------------------


def corpus_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_n(_table(spark, sf_dir, "documents"), "doc_id", 40).select("doc_id", "source")


def corpus_oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return corpus.oversampled(docs, 50, 3, 7, F.col("n_chars") < 3000, F.col("doc_id").cast("string")).select("doc_id", "n_chars")


def corpus_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id").distinct()
    return corpus.joined_by_id(docs, labels, "doc_id")[1]


def corpus_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text, as a key, does not stand among those of one source."""
    docs = _table(spark, sf_dir, "documents")
    return corpus.without_overlap(docs, question_key(F.col("text")), docs.where("source = 'src0'"), question_key(F.col("text"))).select("doc_id")


def repeated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated_questions(_table(spark, sf_dir, "documents"), "text")


def corpus_null_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup over columns in which nulls stand in for values."""
    docs = _table(spark, sf_dir, "documents")
    a = F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("lang"))
    b = F.when(F.col("doc_id") % 3 == 1, None).otherwise(F.col("lang"))
    return corpus.dedup_exact(docs.select("doc_id", a.alias("a"), b.alias("b")), ["a", "b"], "doc_id")


def ordered_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    other = nation.select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 == 0, None).otherwise(F.col("n_regionkey")).alias("r")).where("n_nationkey <> 5")
    found = compare.ordered_difference(nation, other, "n_nationkey")
    return found.select("n_nationkey", F.col("left.n_name").alias("left_name"), F.col("right").isNull().alias("gone"))


def approval_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule over all combinations of its facts, as the bits of a key."""
    bit = lambda i: F.col("c_custkey").bitwiseAND(1 << i) > 0
    rows = _table(spark, sf_dir, "customer")
    return rows.select("c_custkey", compare.approved(bit(0), bit(1), bit(2), bit(3), F.col("c_custkey") % 3, F.when(bit(5), bit(4))).alias("approved"))


# --- training examples -------------------------------------------------------------------------


def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length filter, prompt mask and right padding, in batches of eight; the lengths of words stand in for token ids, the first five are the prompt."""
    ids = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.length(w))
    docs = _table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).select("doc_id", F.slice("ids", 1, 5).alias("p"), F.slice("ids", F.lit(6), F.size("ids")).alias("a"))
    fit = docs.where(collate.fits(F.col("p"), F.col("a"), 400)).select("doc_id", collate.example(F.col("p"), F.col("a")).alias("e"))
    made = collate.collated(fit, "e", "doc_id", 8)
    return made.select("doc_id", "batch", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "labels", "attention_mask")])


# --- generated questions -----------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(responses, briefs): a writer's answer for each nation, faulty in a way that depends on its key."""
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("w-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    k = F.col("k")

    def candidate(i: int, style: str) -> Column:
        said = F.when((k % 5 == i), F.lit("curta?")).when((k % 7 == i) & (k > 6), F.concat(F.lit("Qual tabela mostra quantos em "), "name", F.lit("?"))).otherwise(F.concat(F.lit("Quantos clientes moram em "), "name", F.lit("?")))
        return F.struct(F.concat(F.lit("c"), F.when(k % 11 == 3, F.lit("x")).otherwise(F.lit(str(i)))).alias("id"), F.lit(style).alias("style"), said.alias("question"))

    listed = F.array(*[candidate(i, s) for i, s in enumerate(creative.STYLES)])
    text = F.when(k % 6 == 5, F.lit("no json")).otherwise(F.concat(F.lit("<think>x</think>```json\n"), F.to_json(F.struct(listed.alias("candidates"))), F.lit("\n```")))
    briefs = nation.select("id", F.struct(F.lit("COUNT").alias("aggregation"), F.array(F.lower("name")).alias("literal_values")).alias("brief"))
    return nation.select("id", text.alias("response")), briefs


def question_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = creative.judged_candidates(*_answers(spark, sf_dir))
    return judged.select("id", "candidate_id", "style", "error")


def roundtrip_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and rejections of one judgement, by item: how many of each."""
    jobs, refused = creative.roundtrip_jobs(creative.judged_candidates(*_answers(spark, sf_dir)), least=3)
    both = jobs.select(F.col("writer_job_id").alias("id"), F.lit("job").alias("what")).unionByName(refused.select("id", F.col("stage").alias("what")))
    return both.groupBy("id", "what").agg(F.count(F.lit(1)).alias("n"))


def critic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critics over the nations' approved candidates: choices, scores and the rules they break, and the records that come of it."""
    nation = _table(spark, sf_dir, "nation").select(F.concat(F.lit("w-"), F.col("n_nationkey").cast("string")).alias("writer_job_id"), F.col("n_nationkey").alias("k"))
    k = F.col("k")
    groups = creative.approved_groups(nation.select("writer_job_id", F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("candidate_id"), F.lit("Quantos  há?").alias("question"), F.lit(True).alias("approved")))
    said = F.concat(
        F.lit('{"selected_id": "c'), F.when(k % 9 == 4, "7").otherwise((k % 2).cast("string")), F.lit('", "semantic_fidelity": '), (k % 6).cast("string"), F.lit(', "naturalness": '), F.when(k % 8 == 3, "true").otherwise("4"), F.lit(', "clarity": 5, "reason": "'), F.when(k % 10 == 1, "").otherwise("ok"), F.lit('"}')
    )
    choices = creative.critic_choices(nation.select("writer_job_id", said.alias("response")), groups)
    items = nation.select(F.col("writer_job_id").alias("id"), F.lit("CREATE TABLE t (a)").alias("schema"), F.lit("SELECT 1").alias("sql"), F.lit("train").alias("source_split"))
    final = creative.final_records(choices, groups, items, "s").select("id", "question", F.size("messages").alias("messages"))
    return choices.join(final.withColumnRenamed("id", "writer_job_id"), "writer_job_id", "left").select("writer_job_id", "selected_id", F.array_join("scores", ",").alias("scores"), "error", "question", "messages")


_VERB = "CASE n_nationkey % 3 WHEN 1 THEN 'merge' ELSE 'insert' END"
_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"

OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "view_scan": (view_scan, "SELECT l_returnflag AS flag, count(*) AS lines, round(sum(l_extendedprice::DECIMAL(18,4)), 2)::DOUBLE AS sales FROM lineitem GROUP BY 1"),
    "catalog_columns": (catalog_columns, "SELECT table_name, ordinal_position::INTEGER AS place, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'orders', 'lineitem')"),
    "catalog_integrity": (
        catalog_integrity,
        """SELECT 'repeated_key' AS "check", 'orders' AS subject, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'null_key', 'orders', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL)
UNION ALL SELECT 'repeated_key', 'customer', (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_nationkey <> 3 GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'null_key', 'customer', (SELECT count(*) FROM customer WHERE c_nationkey <> 3 AND c_custkey IS NULL)
UNION ALL SELECT 'orphans', 'orders->customer', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3))""",
    ),
    "sql_policy": (
        sql_policy,
        f"""SELECT n_nationkey AS nation, s::INTEGER AS shape, s IN (0, 1, 6) AS allowed,
CASE WHEN s = 2 THEN 'not_a_read' WHEN s = 3 THEN 'write_verb:' || {_VERB} WHEN s = 4 THEN 'function:reflect' WHEN s = 5 THEN 'multiple_statements' WHEN s = 7 THEN 'path' WHEN s = 8 THEN 'not_a_read' END AS reason FROM nation, range(0, 9) t(s)""",
    ),
    "sql_complexity": (sql_complexity, "SELECT n_nationkey AS nation, s::INTEGER AS shape, CASE s WHEN 0 THEN 'simples' WHEN 1 THEN 'intermediaria' ELSE 'complexa' END AS bucket FROM nation, range(0, 9) t(s) WHERE s IN (0, 1, 6, 8)"),
    "sql_components": (
        sql_components,
        """SELECT n_nationkey AS nation, s::INTEGER AS shape, CASE s WHEN 6 THEN 'customer,nation' ELSE 'customer' END AS relations, CASE s WHEN 0 THEN 'count' WHEN 6 THEN 'sum' ELSE '' END AS aggregates,
(s = 6)::INTEGER AS joins, (s = 6)::INTEGER AS group_by, (s = 1)::INTEGER AS order_by, CASE WHEN s = 1 THEN (10 * n_nationkey + 1)::VARCHAR ELSE '' END AS limit_value, CASE s WHEN 0 THEN 1 ELSE 2 END AS projection FROM nation, range(0, 9) t(s) WHERE s IN (0, 1, 6)""",
    ),
    "sql_assessment": (sql_assessment, "SELECT n_nationkey AS nation, s::INTEGER AS shape, s IN (0, 1, 6) AS parses, s IN (0, 1, 6) AS policy, s IN (0, 1) AS valid FROM nation, range(0, 9) t(s) WHERE s IN (0, 1, 2, 6, 8)"),
    "candidate_scores": (
        candidate_scores,
        "SELECT n_nationkey AS nation, c::INTEGER AS number, (CASE WHEN c = 2 THEN -100 WHEN n_nationkey % 2 = 0 THEN CASE c WHEN 0 THEN 5 ELSE -5 END ELSE CASE c WHEN 0 THEN -2 ELSE 2 END END)::INTEGER AS score FROM nation, range(0, 3) t(c)",
    ),
    "canonical_overlap": (canonical_overlap, "SELECT n_nationkey AS nation FROM nation WHERE n_regionkey = 2"),
    "spec_answers": (spec_answers, _specs_sql()),
    "other_dialects": (other_dialects, "SELECT d AS dialect, year(o_orderdate)::VARCHAR AS y, count(*) AS n FROM orders, (VALUES ('sqlite'), ('postgres'), ('mysql')) t(d) GROUP BY 1, 2"),
    "sketch_schema": (sketch_schema, """SELECT DISTINCT c_nationkey AS nation, 'CREATE TABLE "nation_' || c_nationkey || '" (' || chr(10) || '  "Name" TEXT,' || chr(10) || '  "Segment" TEXT,' || chr(10) || '  "Balance" REAL' || chr(10) || ');' AS ddl FROM customer"""),
    "sketch_brief": (
        sketch_brief,
        """WITH q AS (SELECT * FROM (VALUES (0, 'Name', 'COUNT', 'Segment = BUILDING', 'BUILDING'), (1, 'Balance', 'MAX', 'Balance < 5000', '5000'), (2, 'Balance', 'MIN', 'Segment = MACHINERY AND Balance > 0', 'MACHINERY|0'), (3, 'Balance', 'AVG', 'Balance > 100', '100'), (4, 'Balance', 'SUM', 'Balance < 0', '0'), (5, 'Name', 'none', 'Balance > 9000', '9000')) t(number, result_column, aggregation, conditions, literal_values)),
n AS (SELECT c_nationkey AS nation, count(*) FILTER (c_acctbal > 9000) AS large FROM customer GROUP BY 1)
SELECT nation, number, result_column, aggregation, conditions, literal_values, CASE number WHEN 5 THEN 'list' ELSE 'scalar' END AS answer_shape, CASE number WHEN 5 THEN large ELSE 1 END AS rows FROM n, q""",
    ),
    "sketch_literals": (sketch_literals, "SELECT c_mktsegment AS segment, 'Key,key__2' AS headers, (count(*) FILTER (c_acctbal > 0))::VARCHAR AS positive, NULL::VARCHAR AS error FROM customer GROUP BY 1"),
    "corpus_first_n": (corpus_first_n, "SELECT doc_id, source FROM documents WHERE doc_id < 40"),
    "corpus_oversampled": (corpus_oversampled, "SELECT doc_id, n_chars FROM (SELECT *, sha256('7:' || doc_id) AS h FROM documents ORDER BY h LIMIT 150) WHERE n_chars < 3000 ORDER BY h LIMIT 50"),
    "corpus_missing_ids": (
        corpus_missing_ids,
        "WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0), l AS (SELECT DISTINCT doc_id FROM labels) SELECT (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS missing_right, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS missing_left, (SELECT count(*) FROM d JOIN l USING (doc_id)) AS matched",
    ),
    "corpus_without_overlap": (
        corpus_without_overlap,
        "WITH k AS (SELECT doc_id, source, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM documents) SELECT doc_id FROM k WHERE k NOT IN (SELECT k FROM k WHERE source = 'src0')",
    ),
    "repeated_questions": (
        repeated_questions,
        "SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS question_key, count(*) AS occurrences FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "corpus_null_hash": (
        corpus_null_hash,
        "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS a, CASE WHEN doc_id % 3 <> 1 THEN lang END AS b FROM documents) SELECT min(doc_id) AS doc_id, a, b FROM t GROUP BY a, b",
    ),
    "ordered_difference": (ordered_difference, "SELECT n_nationkey, n_name AS left_name, n_nationkey = 5 AS gone FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey = 5"),
    "approval_rule": (
        approval_rule,
        "SELECT c_custkey, coalesce((c_custkey & 1) > 0 AND (c_custkey & 2) > 0 AND ((c_custkey & 4) > 0 OR ((c_custkey & 8) > 0 AND c_custkey % 3 > 0 AND CASE WHEN (c_custkey & 32) > 0 THEN (c_custkey & 16) > 0 END)), false) AS approved FROM customer",
    ),
    "label_mask": (
        label_mask,
        f"""WITH w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: length(x)) AS w FROM documents),
e AS (SELECT doc_id, doc_id // 8 AS batch, w[1:5] AS p, w[6:] AS a FROM w),
f AS (SELECT *, len(p) + len(a) AS n, max(len(p) + len(a)) OVER (PARTITION BY batch) AS m FROM e WHERE len(a) > 0 AND len(p) + len(a) <= 400)
SELECT doc_id, batch, array_to_string(list_concat(p, a, list_transform(range(m - n), lambda i: 0)), ' ') AS input_ids,
array_to_string(list_concat(list_transform(p, lambda i: -100), a, list_transform(range(m - n), lambda i: -100)), ' ') AS labels,
array_to_string(list_concat(list_transform(range(n), lambda i: 1), list_transform(range(m - n), lambda i: 0)), ' ') AS attention_mask FROM f""",
    ),
    "question_gate": (
        question_gate,
        """WITH s AS (SELECT * FROM (VALUES (0, 'direta'), (1, 'analitica'), (2, 'conversacional'), (3, 'concisa')) t(i, style)),
n AS (SELECT n_nationkey AS k, 'w-' || n_nationkey AS id, CASE WHEN n_nationkey % 6 = 5 THEN 'invalid_json' WHEN n_nationkey % 11 = 3 THEN 'candidate_ids' END AS bad FROM nation)
SELECT id, NULL AS candidate_id, NULL AS style, bad AS error FROM n WHERE bad IS NOT NULL
UNION ALL SELECT id, 'c' || i, style, CASE WHEN k % 5 = i THEN 'shape' WHEN k % 7 = i AND k > 6 THEN 'technical_words' END FROM n, s WHERE bad IS NULL""",
    ),
    "roundtrip_jobs": (
        roundtrip_jobs,
        """WITH n AS (SELECT n_nationkey AS k, 'w-' || n_nationkey AS id, n_nationkey % 6 = 5 OR n_nationkey % 11 = 3 AS bad FROM nation),
c AS (SELECT k, id, bad, CASE WHEN bad THEN 1 ELSE (k % 5 < 4)::INTEGER + (k % 7 < 4 AND k > 6 AND k % 7 <> k % 5)::INTEGER END AS wrong FROM n)
SELECT id, 'candidate' AS what, wrong::BIGINT AS n FROM c WHERE wrong > 0
UNION ALL SELECT id, 'job', 4 - wrong FROM c WHERE NOT bad AND 4 - wrong >= 3
UNION ALL SELECT id, 'item', 1 FROM c WHERE bad OR 4 - wrong < 3""",
    ),
    "critic_gate": (
        critic_gate,
        """WITH n AS (SELECT n_nationkey AS k, 'w-' || n_nationkey AS writer_job_id, CASE WHEN n_nationkey % 9 = 4 THEN 'unknown_selection' WHEN n_nationkey % 8 = 3 OR n_nationkey % 6 = 0 THEN 'score' WHEN n_nationkey % 10 = 1 THEN 'reason' END AS error FROM nation)
SELECT writer_job_id, CASE WHEN error IS NULL THEN 'c' || (k % 2) END AS selected_id, CASE WHEN error IS NULL THEN (k % 6) || ',4,5' END AS scores, error, CASE WHEN error IS NULL THEN 'Quantos  há?' END AS question, CASE WHEN error IS NULL THEN 3 END AS messages FROM n""",
    ),
}
