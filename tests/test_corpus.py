"""Canonical forms, rewriting, batched analysis, ranks, many results at once, budgets and strict assessment."""

import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import compare, corpus
from millrace.plans import analyze, canonical, dialect, execute, gate, strict
from millrace.sources.catalog import register


SAME = [
    ("select a from t where b = 'x'", "SELECT a -- note\nFROM t /* c */ WHERE (b = 'x');"),
    ("select cast(a as int), b from t where c like 'x%'", "SELECT CAST( a AS INT ),b FROM t WHERE c LIKE 'x%'"),
    ("select * from (values (1, 'a')) v(x, y)", "SELECT * FROM (VALUES (1,'a')) v(x,y)"),
]
OTHER = [
    ("select 'a#1L'", "select 'a#2L'"),
    ("select 'a  b'", "select 'a b'"),
    ("select 1", "select 1L"),
    ("select '1'", "select 1"),
    ("select a from t", "select A from t"),
    ("select x from t u", "select x from t v"),
    ("select a as b from t", "select a as c from t"),
    ("select t.* from t", "select * from t"),
    ("select * from (values (1), (2)) v", "select * from (values (1), (3)) v"),
    ("select `a, b` from t", "select a.b from t"),
    ("select a from t group by grouping sets ((a), (b))", "select a from t group by grouping sets ((a, b))"),
    ("select a from t order by a nulls last", "select a from t order by a"),
    ("with a as (select 1) select * from a", "with a as (select 2) select * from a"),
    ("select sum(a) over (rows between 1 preceding and current row) from t", "select sum(a) over (rows between 2 preceding and current row) from t"),
    ("select a from t left join u on x = y", "select a from t right join u on x = y"),
    ("select a from t join u using (k)", "select a from t join u using (l)"),
    ("select a from t where b like 'x' escape '!'", "select a from t where b like 'x' escape '?'"),
    ("select try_cast(a as int)", "select cast(a as int)"),
    ("select count(distinct a) from t", "select count(a) from t"),
    ("select interval 3 days", "select interval 4 days"),
    ("select a from t limit 3", "select a from t limit 4"),
]


def test_canonical_form(spark):
    for a, b in SAME:
        assert canonical.form(spark, a) == canonical.form(spark, b) is not None
    for a, b in OTHER:
        assert None not in (canonical.form(spark, a), canonical.form(spark, b))
        assert canonical.form(spark, a) != canonical.form(spark, b), a
    assert canonical.form(spark, "DROP TABLE t") is None and canonical.form(spark, "((") is None


def test_components_keep_literals(spark):
    one, two = ("SELECT a FROM t WHERE b = 'x#1L''y'", "SELECT a FROM t WHERE b = 'x#2L''y'")
    assert not analyze.compare_components(spark, one, two)["predicates"] and analyze.compare_components(spark, one, one)["predicates"]
    assert not analyze.compare_components(spark, "SELECT a FROM t WHERE b = c", "SELECT a FROM t WHERE b = 'c'")["predicates"]
    assert "x#1l" in analyze.components(spark, one)["predicates"].lower()


@pytest.mark.parametrize("sql", ["SELECT current_user", "SELECT session_user", "SELECT user", "SELECT current_user()", "SELECT USER FROM nation", "SELECT `current_user`", "SELECT current_catalog", "SELECT current_schema", "SELECT 1 WHERE current_database = 'x'", "SELECT version()", "SELECT a FROM t LATERAL VIEW java_method('x') e AS f"])
def test_facts_of_the_session_are_refused(spark, sql):
    assert not gate.check(spark, sql).allowed


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT t.user, t.`current_user` FROM t",
        "SELECT 'user' AS u, current_date",
        "SELECT a FROM t WHERE (a, b) IN (SELECT 1, 2) AND a LIKE ANY ('x', 'y') AND NOT b BETWEEN 1 AND 2 OR c IS DISTINCT FROM d",
        "SELECT a, rank() OVER w, sum(b) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) FROM t WINDOW w AS (ORDER BY a DESC NULLS LAST)",
        "SELECT a, count(*) FROM t GROUP BY ROLLUP (a, b) HAVING count(*) > 1 ORDER BY 1",
        "SELECT trim(BOTH 'x' FROM a), substring(a FROM 1 FOR 2), position('a' IN b), extract(DAY FROM d), date_trunc('month', d), d + INTERVAL 1 DAY, -a, ~b, a & 1 | 2 ^ 3, a[1], s.f, CAST(a AS INT), a::string, if(a, b, c) FROM t",
        "SELECT transform(a, x -> x + 1), e FROM t LATERAL VIEW OUTER explode(b) x AS e",
        "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.k = t.k) AND b = (SELECT max(c) FROM v)",
        "SELECT any_value(a), first(b) IGNORE NULLS, count(DISTINCT c) FILTER (WHERE d > 0), listagg(a, ';') WITHIN GROUP (ORDER BY b) FROM t",
    ],
)
def test_reads_of_every_kind_pass(spark, sql):
    assert gate.check(spark, sql).allowed, gate.check(spark, sql)


def test_analysis_in_batches_is_resumed(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, f"SELECT {i % 40}") for i in range(100)] + [(40, None)], "i int, q string")
    store, seen = str(tmp_path / "verdicts"), []

    def judge(sql):
        if len(seen) == 25:
            raise RuntimeError("stopped")
        seen.append(sql)
        return (len(sql),)

    with pytest.raises(RuntimeError):
        analyze.with_analysis(df, "q", judge, "n int", store=store, batch=10)
    assert spark.read.parquet(store).count() == 20  # two whole batches are kept, the third is lost
    first = list(seen)
    seen.clear()
    out = analyze.with_analysis(df, "q", lambda s: (seen.append(s) or len(s),), "n int", store=store, batch=10)
    assert len(seen) == 20 and not set(seen) & set(first[:20])
    assert out.count() == 101 and out.where("q IS NOT NULL AND n <> length(q)").isEmpty() and out.where("q IS NULL").first()["n"] is None
    assert analyze.with_analysis(df, "q", lambda s: 1 / 0, "n int", store=store).where("n IS NULL").count() == 1  # nothing is left to analyse


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT DATE_FORMAT(DATE(x), '%Y') FROM t", "SELECT date_format(DATE(x), 'yyyy') FROM t"),
        ("SELECT DATE_SUB(DATE(x), INTERVAL 3 DAY) FROM t", "SELECT date_sub(DATE(x), 3) FROM t"),
        ("SELECT date_add(x, interval (a + 1) month)", "SELECT (x + make_interval(months => (a + 1)))"),
        ("SELECT DATE_SUB(x, INTERVAL 2 QUARTER)", "SELECT (x - make_interval(months => 3 * (2)))"),
        ("SELECT GROUP_CONCAT(a ORDER BY b SEPARATOR ';') FROM t", "SELECT listagg(CAST(a AS STRING), ';') WITHIN GROUP (ORDER BY b) FROM t"),
        ("SELECT GROUP_CONCAT(DISTINCT a SEPARATOR ' (') FROM t", "SELECT array_join(array_sort(collect_set(a)), ' (') FROM t"),
        ("SELECT GROUP_CONCAT(a, ' ', b) FROM t", "SELECT array_join(array_sort(collect_list(concat(a, ' ', b))), ',') FROM t"),
        ("SELECT a # note\nFROM t -- more\nWHERE b = '# -- /* x */' /* y */;", "SELECT a  \nFROM t  \nWHERE b = '# -- /* x */'"),
        ("SELECT a FROM `t; x` WHERE b = \"it's \"\"so\"\"\"", "SELECT a FROM `t; x` WHERE b = 'it\\'s \"so\"'"),
        ("SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5"),
        ("SELECT a FROM (SELECT b FROM u LIMIT 1, 2) t LIMIT 3", "SELECT a FROM (SELECT b FROM u LIMIT 2 OFFSET 1) t LIMIT 3"),
        ("SELECT a FROM t FORCE INDEX (i, j) WHERE a REGEXP '^x'", "SELECT a FROM t  WHERE a RLIKE '^x'"),
        ("SELECT a FROM t STRAIGHT_JOIN u ON t.k = u.k && u.l > 1", "SELECT a FROM t JOIN u ON t.k = u.k AND u.l > 1"),
        ("SELECT IFNULL(IF(ISNULL(a), 1, 2), TRUNCATE(b, 1))", "SELECT coalesce(IF((a IS NULL), 1, 2), (CAST(b * power(10, 1) AS BIGINT) / power(10, 1)))"),
        ("SELECT CAST(a AS SIGNED), CONVERT(b, CHAR), CAST(c AS DECIMAL(10, 2)), CONVERT(d USING utf8)", "SELECT CAST(a AS BIGINT), CAST(b AS STRING), CAST(c AS DECIMAL(10, 2)), d"),
        ("SELECT a FROM t WHERE (a, b) IN (SELECT IFNULL(c, 1), d FROM u)", "SELECT a FROM t WHERE (a, b) IN (SELECT coalesce(c, 1), d FROM u)"),
        ("SELECT DATE_FORMAT(x, '%d at %H:%i')", "SELECT date_format(x, 'dd \\'at\\' HH:mm')"),
    ],
)
def test_mysql(spark, sql, want):
    assert dialect.from_mysql(sql) == want
    gate.parse(spark, want)


@pytest.mark.parametrize("sql", ["SELECT sleep(1)", "SELECT DATE_FORMAT(x, '%Q')", "SELECT DATE_FORMAT(x, y)", "SELECT 1; SELECT 2", "", "SELECT (1", "SELECT 1)", "SELECT DATE_ADD(x, INTERVAL 1 FORTNIGHT)", "SELECT CAST(a AS GEOMETRY)"])
def test_mysql_without_an_equal_form(sql):
    with pytest.raises(ValueError):
        dialect.from_mysql(sql)


def _tree(lines, width):
    """The tree of digests by brute force, over (position, line)."""
    rows = sorted(((p is not None, p or 0, hashlib.sha256(t.encode()).hexdigest()) for p, t in lines))
    level = [r[2] for r in rows]
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + width]).encode()).hexdigest() for i in range(0, len(level), width)]
        if len(level) <= 1:
            return level[0] if level else None


@pytest.mark.parametrize("kind", ["dense", "sparse", "negative", "repeated", "one", "none", "null"])
def test_fingerprint_over_ranks(spark, kind):
    rng = random.Random(7)
    position = {"dense": lambda i: i, "sparse": lambda i: rng.getrandbits(62), "negative": lambda i: -i * 10**9, "repeated": lambda i: i % 3, "one": lambda i: 5, "none": lambda i: i, "null": lambda i: None if i % 4 == 0 else i}[kind]
    lines = [(position(i), f"line {i % 50}") for i in range(0 if kind == "none" else 300)]
    df = spark.createDataFrame(lines, "p long, t string").repartition(5)
    got = corpus.fingerprint(df, F.col("t"), F.col("p"), width=8).first()[0]
    assert got == _tree(lines, 8)


def test_ranks_have_no_gaps(spark):
    rows = [(i * 37 % 101, "x") for i in range(500)]
    got = corpus.ranked(spark.createDataFrame(rows, "k int, t string").repartition(7), "k")
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(500))
    assert [r["k"] for r in got.orderBy("rank").collect()] == sorted(r[0] for r in rows)


def test_many_results_at_once(spark):
    rng = random.Random(3)
    values = [None, "", "a", "b", "null"]
    rows, want = [], {}
    for pair in range(60):
        a = [(rng.choice(values), rng.choice([None, 1, 2])) for _ in range(rng.randrange(5))]
        b = a[::-1] if pair % 3 else [(rng.choice(values), rng.choice([None, 1, 2])) for _ in range(rng.randrange(5))]
        if pair % 7 == 0 and b:
            b = b + [b[0]]
        rows += [(pair, "a", *r) for r in a] + [(pair, "b", *r) for r in b]
        if a or b:
            want[pair] = (len(a), len(b), Counter(a) == Counter(b))
    rows += [(None, "a", "x", 1), (None, "b", "x", 1)]
    want[None] = (1, 1, True)
    rows += [(100, "a", None, 1), (100, "b", "1", None), (101, "a", "p", 1), (101, "a", "q", 2), (101, "b", "p", 2), (101, "b", "q", 1)]
    want[100], want[101] = (1, 1, False), (2, 2, False)
    df = spark.createDataFrame(rows, "id int, s string, x string, y int").repartition(6)
    got = {r["id"]: (r["rows_a"], r["rows_b"], r["equal"]) for r in compare.paired_results(df, "id", "s", ["x", "y"]).collect()}
    assert got == want
    assert compare.paired_results(df.where("id < 0"), "id", "s", ["x", "y"]).count() == 0


def test_equal_hashes_are_recounted(spark, monkeypatch):
    monkeypatch.setattr(compare, "row_prints", lambda columns: [F.lit(1).cast("long"), F.lit(1).cast("long")])
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "x")], "id int, s string, v string")
    assert {r["id"]: r["equal"] for r in compare.paired_results(df, "id", "s", ["v"]).collect()} == {1: False, 2: True}


def test_a_cross_join_is_stopped_by_its_budget(spark, sf_dir):
    register(spark, sf_dir, ["lineitem", "nation"])
    slow = "SELECT count(*) AS n FROM lineitem a CROSS JOIN lineitem b CROSS JOIN nation c WHERE hash(a.l_orderkey, b.l_orderkey, c.n_name) % 7 = 1"
    began = time.time()
    found = execute.run(spark, slow, ["lineitem", "nation"], timeout_ms=30_000, budget=execute.Budget(task_seconds=1.0))
    assert not found.executed and found.error.startswith("work_budget") and "task_seconds" in found.error and time.time() - began < 20
    small = execute.run(spark, "SELECT count(*) FROM nation", ["nation"], budget=execute.Budget(tasks=1000, records=10_000_000, task_seconds=600))
    assert small.executed
    many = execute.run(spark, slow, ["lineitem", "nation"], timeout_ms=30_000, budget=execute.Budget(records=10))
    assert "records" in many.error


DDL = """CREATE TABLE public.vendas (id SERIAL PRIMARY KEY, cliente VARCHAR(20), valor NUMERIC(10, 2) NOT NULL, tags TEXT[], quando TIMESTAMP, CONSTRAINT c CHECK (valor > 0));
CREATE TABLE "loja" ("nome" TEXT, cidade CHAR(2), aberta BOOLEAN, FOREIGN KEY (nome) REFERENCES vendas (cliente));"""


@pytest.mark.parametrize(
    ("sql", "rule"),
    [
        ("SELECT cliente, sum(valor) AS total FROM vendas GROUP BY cliente ORDER BY total", None),
        ("SELECT v.cliente FROM vendas v JOIN loja l ON l.nome = v.cliente WHERE l.aberta", None),
        ("WITH g AS (SELECT cliente AS c FROM vendas) SELECT c FROM g WHERE exists (SELECT 1 FROM loja WHERE nome = c)", None),
        ("SELECT nome FROM vendas", "unresolved_column"),  # a column of the other table
        ("SELECT v.nome FROM vendas v JOIN loja l ON l.nome = v.cliente", "unresolved_column"),
        ("SELECT cliente FROM vendas WHERE id IN (SELECT cidade2 FROM loja)", "unresolved_column"),
        ("SELECT cliente, sum(valor) FROM vendas", "missing_group_by"),
        ("SELECT id FROM vendas a JOIN vendas b ON a.id = b.id", "ambiguous_reference"),
        ("SELECT id FROM clientes", "out_of_scope"),
        ("DELETE FROM vendas", "refused"),
        ("SELECT sum(tags) FROM vendas", "datatype_mismatch"),
        ("SELECT id FROM vendas WHERE (", "unparsable"),
    ],
)
def test_strict_assessment(spark, sql, rule):
    session = strict.isolated(spark, DDL)
    found = strict.assess(session, sql, {"vendas", "loja"})
    assert found.rule == rule and found.valid is (rule is None)
    assert "loja" not in [t.name for t in spark.catalog.listTables()]


def test_typed_tables():
    assert strict.typed_tables(DDL) == {
        "vendas": [("id", "bigint"), ("cliente", "string"), ("valor", "decimal(10,2)"), ("tags", "array<string>"), ("quando", "timestamp")],
        "loja": [("nome", "string"), ("cidade", "string"), ("aberta", "boolean")],
    }


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT to_char(d, 'YYYY-MM-DD HH24:MI') FROM public.t;", "SELECT date_format(d, 'yyyy-MM-dd HH:mm') FROM t"),
        ("SELECT string_agg(a, '; ' ORDER BY b DESC), string_agg(DISTINCT a, ',') FROM t", "SELECT listagg(CAST(a AS STRING), '; ') WITHIN GROUP (ORDER BY b DESC), listagg(DISTINCT CAST(a AS STRING), ',') FROM t"),
        ("SELECT string_agg(upper(coalesce(a, 'x')), '\\' ORDER BY a) FROM t", "SELECT listagg(CAST(upper(coalesce(a, 'x')) AS STRING), '\\\\') WITHIN GROUP (ORDER BY a) FROM t"),
        ('SELECT "a b", t."c""d" FROM "t" WHERE e ~* \'^x\\d\'', 'SELECT `a b`, t.`c"d` FROM `t` WHERE e RLIKE \'(?i)^x\\\\d\''),
        ("SELECT a FROM t WHERE t.a = ANY(ARRAY[1, f(2)]) AND f(a) = ANY (SELECT b FROM u) FETCH FIRST 3 ROWS ONLY", "SELECT a FROM t WHERE array_contains(array(1, f(2)), t.a) AND f(a) IN (SELECT b FROM u) LIMIT 3"),
        ("SELECT round(avg(x)::numeric, 2), x::numeric(10,2), y::double precision, z::text[], CAST(u AS character varying(5)) FROM t", "SELECT round(avg(x)::DECIMAL(38, 10), 2), x::DECIMAL(10,2), y::DOUBLE, z::ARRAY<STRING>, CAST(u AS STRING) FROM t"),
        ("SELECT $$it's \\n$$, E'a\\'b\\n', 'it''s', $q$x$$y$q$", "SELECT 'it\\'s \\\\n', 'a\\'b\\n', 'it\\'s', 'x$$y'"),
        ("SELECT extract(dow FROM d), date_part('month', d), extract(epoch FROM d) FROM t", "SELECT (dayofweek(d) - 1), extract(MONTH FROM d), unix_timestamp(d) FROM t"),
        ("SELECT array_agg(x ORDER BY x DESC), n FROM t, generate_series(1, 5) AS g(n) WHERE tags @> ARRAY['a'] GROUP BY n", "SELECT sort_array(collect_list(x), false), n FROM t, (SELECT explode(sequence(1, 5))) AS g(n) WHERE size(array_except(array('a'), tags)) = 0 GROUP BY n"),
    ],
)
def test_postgres(spark, sql, want):
    assert dialect.from_postgres(sql) == want
    gate.parse(spark, want)


@pytest.mark.parametrize("sql", ["SELECT DISTINCT ON (a) a FROM t", "SELECT pg_sleep(1)", "SELECT age(a)", "SELECT regexp_replace(a, 'b', 'c')", "SELECT to_char(d, 'J')", "SELECT a SIMILAR TO 'b'", "SELECT x::geometry", "SELECT a = ANY b", "SELECT 1; SELECT 2", "SELECT ARRAY[1", "SELECT array_agg(a ORDER BY b) FROM t"])
def test_postgres_without_an_equal_form(spark, sql):
    with pytest.raises(ValueError):
        dialect.from_postgres(sql)
    assert analyze.canonical(spark, sql, "postgres") is None


def test_forms_across_dialects(spark):
    assert analyze.exact_match(spark, 'SELECT "a"::text FROM public.t WHERE b ~ $$x$$', "select a::varchar from t where b ~ 'x'", "postgres")
    assert analyze.exact_match(spark, "SELECT a::text FROM public.t WHERE b ~ $$x$$", "select a::varchar from t where b ~ 'x'", "postgres")
    assert not analyze.exact_match(spark, "SELECT a FROM t WHERE b ~ 'x'", "SELECT a FROM t WHERE b ~* 'x'", "postgres")
    assert analyze.exact_match(spark, "SELECT IFNULL(a, 1) FROM t LIMIT 2, 3", "SELECT coalesce(a, 1) FROM t LIMIT 3 OFFSET 2", "mysql")
