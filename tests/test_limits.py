"""Results that hold beyond the sizes of the test tables."""

import hashlib
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import more_queries, queries
from millrace.llm import _graph, maxent, spelling
from millrace.operators import corpus
from millrace.plans import analyze, execute, gate
from millrace.sources import catalog
from oracle import assert_same


def test_fingerprint_in_two_levels(spark):
    """300 lines of width 8 are 38 groups: more than one group of groups, which two levels take as one."""
    lines = [hashlib.sha256(f"line {i}".encode()).hexdigest() for i in range(300)]
    groups = [hashlib.sha256("\n".join(lines[i : i + 8]).encode()).hexdigest() for i in range(0, 300, 8)]
    df = spark.range(300).select("id", F.format_string("line %d", "id").alias("t")).repartition(5)
    got = corpus.fingerprint(df, F.col("t"), F.col("id"), width=8, levels=2).first()[0]
    assert got == hashlib.sha256("\n".join(groups).encode()).hexdigest()
    few = corpus.fingerprint(df.where("id < 8"), F.col("t"), F.col("id"), width=8, levels=2).first()[0]
    assert few == groups[0]


def test_candidates_return_all_rows(spark, tmp_path):
    """A record's table with more than 1,000 rows that meet a sketch: its list is whole."""
    rows = spark.range(1200).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), F.lit(3).cast("long").alias("c_nationkey"), F.lit(9500.5).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    assert_same(spark, str(tmp_path), queries.sketch_candidates, queries.oracle_sql()["sketch_candidates"])


def test_keys_of_words_are_never_broadcast(spark):
    """Small tables of words are joined by sorting as well: what is broadcast passes through the driver."""
    words = spark.range(2000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("word"), F.lit(5).cast("long").alias("n")).localCheckpoint()
    near = spelling.forms(words.withColumn("word", F.col("word").substr(1, 9)))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_one_text_of_each_shape_is_parsed(spark, monkeypatch):
    """Verdicts by shape are those of each text; texts that differ in plain values are parsed once."""
    forms = ["SELECT {k} AS a, '{k}; --' AS b", "SELECT ({k} FROM nation", "SELECT {k}; SELECT '{k}'", "SELECT a FROM t WHERE b % {k} = 0 AND c = 'n {k}'"]
    odd = ["SELECT 40000S", "SELECT 400S", "SELECT CAST(1 AS decimal(50, 2))", "SELECT CAST(1 AS decimal(10, 2))", "SELECT DATE '2020-01-01'", "SELECT DATE 'x'", "SELECT INTERVAL -5 DAY", "SELECT a LIKE 'b' ESCAPE 'cd'"]
    texts = [f.replace("{k}", str(k)) for f in forms for k in range(1, 40)] + odd
    assert len({gate.shape(t) for t in texts}) == len(forms) + len(odd)

    def alone(sql):
        parts = gate.statements(sql)
        if len(parts) > 1:
            return "multiple_sql_statements"
        try:
            gate.parse(spark, parts[0])
        except Exception:
            return "invalid_sql"

    want, parsed, parse = {t: alone(t) for t in texts}, [], gate.parse
    assert {want["SELECT 40000S"], want["SELECT DATE 'x'"]} == {"invalid_sql"}
    monkeypatch.setattr(gate, "parse", lambda s, sql: parsed.append(sql) or parse(s, sql))
    got = corpus.parse_verdicts(spark.createDataFrame([(t,) for t in texts], "sql string"), "sql").collect()
    assert {r["sql"]: r["verdict"] for r in got} == want and len(got) == len(texts)
    assert len(parsed) == len(forms) + len(odd) - 1


def test_runs_without_a_deadline(spark):
    """A query that may take as long as it takes gives all its rows; deadlines that are set keep their bounds."""
    found = execute.run(spark, "SELECT count(*) AS n FROM range(0, 1000)", ["range"], timeout_ms=None)
    assert found.executed and found.rows == ((1000,),)
    with pytest.raises(ValueError):
        execute.run(spark, "SELECT 1 AS a", [], timeout_ms=30_001)


def test_specifications_broadcast_no_table_of_unknown_size(spark, sf_dir, tmp_path, monkeypatch):
    """NOT IN over columns without nulls is a join that can be sorted, others keep their meaning; tables are broadcast by counted sizes, in a session of the specifications' own."""
    sessions, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(execute, "run", lambda s, *a, **k: sessions.append(s) or execute.Execution(True, True))
    more_queries.spec_answers(spark, sf_dir)
    own, text = sessions[0], "SELECT count(*) AS total FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')"
    assert int(own.conf.get("spark.sql.autoBroadcastJoinThreshold")) == catalog.PACKED and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == before and own.conf.get("spark.sql.session.timeZone") == "UTC"
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = own.sql(text)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Broadcast" not in plan
    catalog.register(spark, sf_dir, ["orders", "lineitem"])
    assert own.sql(text).collect() == spark.sql(text).collect()
    spark.createDataFrame([(1,), (2,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1,), (None,)], "l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    catalog.register_known(own, str(tmp_path), more_queries.SPEC_KEYS)
    assert own.sql("SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)").count() == 0


def test_many_texts_of_few_shapes(spark, sf_dir, tmp_path, monkeypatch, capfd):
    """Texts of one shape share the gate's parse and the name that is not there, and over a held table need no job; each says what it says alone."""
    catalog.register_held(spark, sf_dir, ["nation"])
    forms = ["SELECT n_name, {k} AS k FROM nation", "SELECT nome, {k} AS k FROM nation", "SELECT n_name FROM region WHERE r_regionkey > {k}", "SELECT n_name FROM nation WHERE n_nationkey / ({k} - 3) > 0", "SELECT n_name, n_regionkey FROM nation GROUP BY 1, {k}", "DELETE FROM nation WHERE n_nationkey = {k}"]
    odd = ["SELECT n_name FROM IDENTIFIER('nation')", "SELECT n_name FROM IDENTIFIER('region')"]
    texts = [f.replace("{k}", str(k)) for f in forms for k in range(1, 7)] + odd
    want = [execute.run(spark, t, ["nation"]) for t in texts]
    assert {w.error and w.error.split(" ")[0] for w in want} >= {None, "DIVIDE_BY_ZERO", "not_a_read", "out_of_scope:", "UNRESOLVED_COLUMN.WITH_SUGGESTION"}
    judge, parsed, parse = execute.Judge(spark, ["nation"]), [], gate.parse
    monkeypatch.setattr(gate, "parse", lambda s, sql: parsed.append(sql) or parse(s, sql))
    capfd.readouterr()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    assert [execute.run(spark, t, ["nation"], judge=judge) for t in texts] == want
    assert len(parsed) <= 3 * (len(forms) - 1 + len(odd)) and len(judge.unresolved) == 1
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - jobs <= 6  # of GROUP BY alone
    assert "JVM stacktrace" not in capfd.readouterr().err
    catalog.register_held(spark, sf_dir, ["nation"], most=24)
    assert "LocalRelation" not in spark.table("nation")._jdf.queryExecution().optimizedPlan().toString()


def test_errors_before_a_value_is_read_are_met_once(spark, sf_dir, monkeypatch):
    """Texts that fail before they read their value run once, and say what each says alone; others, whose value decides, all run."""
    catalog.register_held(spark, sf_dir, ["nation"])
    alike = ["SELECT n_name FROM nation WHERE n_nationkey / (n_nationkey - n_nationkey) > {k}", "SELECT n_name, n_regionkey FROM nation\nWHERE (n_nationkey + 2147483647) * 2 <= {k}"]
    decides = [
        "SELECT n_name FROM nation WHERE n_nationkey / (n_nationkey - 3) > {k}",
        "SELECT n_name FROM nation WHERE n_nationkey / (n_nationkey - {k}) > 1",
        "SELECT n_name FROM nation WHERE n_nationkey / 0 > 1 AND 2 > {k}",
        "SELECT n_name FROM nation WHERE CASE WHEN n_nationkey / 0 > 1 THEN 1 ELSE 2 END > {k}",
        "SELECT n_name FROM nation WHERE 1 = 0 AND n_nationkey / 0 > {k}",
        "SELECT n_nationkey / 0 AS a FROM nation WHERE n_nationkey > {k}",
    ]
    texts = [f.replace("{k}", str(k)) for f in alike + decides for k in (0, 1, 2, 5, 999)]
    want = [execute.run(spark, t, ["nation"]) for t in texts]
    assert {w.error and w.error.split(" ")[0] for w in want} == {None, "DIVIDE_BY_ZERO", "ARITHMETIC_OVERFLOW"}
    judge, ran, capped = execute.Judge(spark, ["nation"]), [], execute.capped
    monkeypatch.setattr(execute, "capped", lambda df, n: ran.append(n) or capped(df, n))
    assert [execute.run(spark, t, ["nation"], judge=judge) for t in texts] == want
    assert sum(v is not None for v in judge.before_value.values()) == len(alike) + 1  # that of "(n_nationkey - 0) >", which is one text's
    assert ran.count(101) == len(alike) + 5 * len(decides)


def test_threads_do_not_share_local_properties(spark):
    """What one thread's query leaves in Spark's local properties is not seen by another's, where it made a query fail now and then."""
    sc = spark.sparkContext

    def ran(text: str) -> tuple:
        sc.setLocalProperty("millrace.text", text)
        time.sleep(0.05)
        return (sc.getLocalProperty("millrace.text"),)

    texts = spark.createDataFrame([(f"t{i}",) for i in range(24)], "sql string")
    got = analyze.with_analysis(texts, "sql", ran, "seen string", threads=8).collect()
    assert len(got) == 24 and all(r["seen"] == r["sql"] for r in got)


def test_driver_gets_one_number_a_weight(spark, monkeypatch):
    """A round of the language model brings the driver one ratio a weight, not both sums, and the weights they give."""
    expected, observed = np.arange(8) * maxent.SCALE, np.arange(8)[::-1]
    rows = [(0, bytearray(np.r_[expected, observed].astype(np.int64).tobytes()))]
    got = maxent._ratios(spark.createDataFrame(rows, "chunk int, counts binary")).collect()
    assert len(got) == 1 and len(got[0]["ratios"]) == 8 * len(expected)
    assert np.array_equal(np.frombuffer(got[0]["ratios"], np.float64), np.log((observed + maxent.SMOOTH) / (expected / maxent.SCALE + maxent.SMOOTH)))


def test_rounds_over_few_edges_are_not_dealt_out(spark, monkeypatch):
    """A round over few edges leaves them in one task, whatever the number of shuffle partitions; more edges take more tasks, with the same components."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)], "a long, b long")
    monkeypatch.setitem(vars(_graph), "cut", lambda df: parts.append(df.rdd.getNumPartitions()) or df.localCheckpoint())
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (_graph.PER_TASK, 7):
            parts = []
            monkeypatch.setattr(_graph, "PER_TASK", most)
            assert {r["id"]: r["component"] for r in _graph.components(edges).collect()} == want
            assert max(parts[1:]) == 1 or most == 7
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["join_inner_on_chain", "heavy_eight_relations"])
def test_lines_of_a_task_do_not_grow_with_the_table(spark, sf_dir, monkeypatch, name):
    """Lines are sorted and grouped a bounded number a task, however few partitions a shuffle has, with the results of the SQL; small tables are read as ever."""
    query = queries.queries()[name]
    query(spark, sf_dir)
    assert "Repartition" not in spark.table("lineitem")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(catalog, "PER_TASK", 300, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert_same(spark, sf_dir, query, queries.oracle_sql()[name])
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = spark.table("lineitem")
    tasks = -(-lines.count() // 300)
    assert tasks > 4 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for key in ("l_orderkey", "o_orderkey"):
        assert re.search(rf"hashpartitioning\({key}#\d+L, {tasks}\)", plan)
    assert max(r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()) < 3 * 300
