import json

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.operators import compare, corpus, creative, sketch, specs
from millrace.plans import execute
from millrace.sources import files
from millrace.sources.catalog import Catalog, compile_context, ddl, profile, register, table_schema

CATALOG = json.dumps(
    {
        "name": "winery",
        "dialect": "sqlite",
        "tables": {
            "barrels": {"columns": {"barrel_id": "TEXT", "litres": "REAL"}, "primary_key": ["barrel_id"]},
            "tastings": {"columns": {"tasting_id": "TEXT", "barrel_id": "TEXT", "guide": "TEXT"}, "primary_key": ["tasting_id"]},
            "wages": {"columns": {"person": "TEXT", "amount": "REAL"}},
        },
        "relationships": [
            {"from_table": "tastings", "from_columns": ["barrel_id"], "to_table": "barrels", "to_columns": ["barrel_id"]},
            {"from_table": "tastings", "from_columns": ["guide"], "to_table": "wages", "to_columns": ["person"], "kind": "soft", "note": "by name"},
        ],
        "packs": {"cellar": {"tier": "small", "tables": ["barrels", "tastings"]}, "all": {"tier": "heavy", "tables": ["barrels", "tastings", "wages"]}},
    }
)


def test_catalog():
    c = Catalog.load(CATALOG)
    text = c.render_pack("cellar")
    assert "hard relationship: tastings.barrel_id -> barrels.barrel_id" in text and "wages" not in text
    assert c.render_pack("all").endswith("-- soft relationship: tastings.guide ~> wages.person (by name)")
    with pytest.raises(KeyError):
        c.pack("none")
    for change in (("sqlite", "oracle"), ('"small"', '"huge"'), ('"to_table": "barrels"', '"to_table": "casks"')):
        with pytest.raises(ValueError):
            Catalog.load(CATALOG.replace(*change))


def test_integrity_and_frames(spark):
    c = Catalog.load(CATALOG)
    tables = {
        "barrels": spark.createDataFrame([("b1", 1.0)], "barrel_id string, litres double"),
        "tastings": spark.createDataFrame([("t1", "b1", "x"), ("t1", "b2", "x"), (None, None, None)], "tasting_id string, barrel_id string, guide string"),
        "wages": spark.createDataFrame([], "person string, amount double"),
    }
    got = {(r["check"], r["subject"]): r["violations"] for r in c.integrity(tables).collect()}
    assert got[("repeated_key", "tastings")] == 1 and got[("null_key", "tastings")] == 1 and got[("orphans", "tastings->barrels")] == 1
    assert c.frames(spark)["catalog_packs"].count() == 5


def test_context_budget_and_schema(spark, sf_dir):
    register(spark, sf_dir, ["nation", "region"])
    text = table_schema(spark, "nation", hints={"nation": ["n_regionkey"]})
    assert text.startswith("CREATE TABLE nation") and "-- rows: 25" in text
    context = compile_context(["Nation", "nation"], lambda n: ddl(n, [("a", "INT")]))
    assert context.relations == ("nation",)
    with pytest.raises(ValueError):
        compile_context(["nation"], lambda n: "x" * 300, 256)
    with pytest.raises(ValueError):
        table_schema(spark, "nation; drop")
    assert profile(spark, ["region"])["rows"] == {"region": 5}


def test_rejections_and_split(spark):
    rows = [(0, "Q  1", "CREATE TABLE t(a)", "SELECT a FROM t"), (1, "Q 1", "CREATE TABLE t(a)", "SELECT a FROM t"), (2, " ", "x", "SELECT 1"), (3, "q", "x" * 99, "SELECT 1"), (4, "q", "x", "((("), (5, "q", "x", "SELECT 1; SELECT 2")]
    df = corpus.normalize(spark.createDataFrame(rows, "pos int, q string, s string, a string"), "q", "s", "a")
    df = corpus.parse_verdicts(df, "a")
    got = {r["reason"]: r["rows"] for r in corpus.rejection_histogram(df, ["q", "s", "a"], "pos", 50, "verdict").collect()}
    assert got == {"missing_required_field": 1, "too_long": 1, "invalid_sql": 1, "multiple_sql_statements": 1, "accepted": 1, "duplicate": 1}
    split = corpus.group_split(df, F.col("s"), 50)
    assert corpus.leaking_groups(split).isEmpty()
    with pytest.raises(ValueError):
        corpus.group_split(df, F.col("s"), 51)


def test_stratified_fill_and_fingerprint(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(20)], "id int, bucket string")
    got = corpus.stratified_sample(df, "bucket", F.sha2(F.col("id").cast("string"), 256), 10, ["a", "b", "c"])
    assert {r["bucket"]: r["count"] for r in got.groupBy("bucket").count().collect()} == {"a": 3, "b": 7}
    with pytest.raises(ValueError):
        corpus.stratified_sample(df.where("id < 0"), "bucket", F.col("id"), 5, ["a"])
    big = spark.range(9000)
    one = corpus.fingerprint(big, F.col("id").cast("string"), F.col("id")).first()[0]
    assert one == corpus.fingerprint(big.repartition(7), F.col("id").cast("string"), F.col("id")).first()[0]
    assert one != corpus.fingerprint(big.where("id > 0"), F.col("id").cast("string"), F.col("id")).first()[0]


def test_hash_tells_nulls_apart(spark):
    rows = [(0, "x", None), (1, None, "x"), (2, "x", ""), (3, None, None), (4, "", ""), (5, "x", None)]
    df = spark.createDataFrame(rows, "pos int, a string, b string")
    assert [r["pos"] for r in corpus.dedup_exact(df, ["a", "b"], "pos").orderBy("pos").collect()] == [0, 1, 2, 3, 4]


def test_samples_and_ids(spark):
    df = spark.range(100).withColumn("size", F.col("id") % 10)
    got = corpus.oversampled(df, 10, 4, 7, F.col("size") < 8, F.col("id").cast("string")).collect()
    again = corpus.oversampled(df.repartition(5), 10, 4, 7, F.col("size") < 8, F.col("id").cast("string")).collect()
    assert len(got) == 10 and got == again and all(r["size"] < 8 for r in got)
    both, missing = corpus.joined_by_id(spark.range(5), spark.range(3, 9), "id")
    assert both.count() == 2 and missing.first().asDict() == {"missing_right": 3, "missing_left": 4, "matched": 2}


def test_compare(spark):
    a, b = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(2, "x"), (1, None), (1, None)], "k int, v string")
    assert compare.multiset_equal(a, b) and not compare.multiset_equal(a, b.distinct())
    assert compare.compare_reports({"fingerprint": "f", "examples": 2, "ok_rate": 0.5}, {"fingerprint": "f", "examples": 2, "ok_rate": 1.0}) == {"ok_rate": 0.5}
    with pytest.raises(ValueError):
        compare.compare_reports({"fingerprint": "f"}, {"fingerprint": "g"})


def test_sketch_literals(spark):
    table = "{'header': array(['Name', 'Name', 'Pts'], dtype=object), 'types': array(['text', 'text', 'real'], dtype=object), 'rows': [['a', 'x', '1'], ['b', 'y', '2.5'], ['b', nan, None]], 'id': 't-1', 'name': ''}"
    query = "{'sel': 2, 'agg': 4, 'conds': {'column_index': [0], 'operator_index': [0], 'condition': ['b']}}"
    bad = "{'sel': 2, 'agg': 9, 'conds': {'column_index': [], 'operator_index': [], 'condition': []}}"
    df = spark.createDataFrame([(1, table, query), (2, table, bad), (3, "__import__('os')", query)], "id int, t string, q string")
    got = sketch.parsed(df, "t", "q", "id").withColumn("answer", sketch.run_sketch(F.col("table"), F.col("sketch"))).withColumn("sql", sketch.render_sql(F.col("table"), F.col("sketch")))
    rows = {r["id"]: r for r in got.collect()}
    assert rows[1]["table"]["headers"] == ["Name", "Name__2", "Pts"]
    assert rows[1]["answer"] == ["2.5"] and rows[1]["sql"] == """SELECT SUM("Pts") FROM "t-1" WHERE "Name" = 'b'"""
    assert rows[2]["error"] and rows[3]["error"]
    ran = sketch.execute_candidates(got.where("id = 1").select("id", "table", "sql"), "id", "table", "sql").first()
    assert ran["executed"] and ran["rows"] == [["2.5"]]
    blocked = sketch.execute_candidates(got.where("id = 1").select("id", "table", F.lit("DROP TABLE x").alias("sql")), "id", "table", "sql").first()
    assert not blocked["executed"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("{'a': [1, -2, +3, 4.5, .5, 1e3], 'b': (True, None), 'c': nan}", {"a": [1, -2, 3, 4.5, 0.5, 1000.0], "b": [True, None], "c": None}),
        ("array(['x', \"y'z\", 'q\\'r'], dtype=object)", ["x", "y'z", "q'r"]),
        ("{'k': array([array([1, 2,], dtype=int64), array([3])]), 't': ((1), (1,), ()),}", {"k": [[1, 2], [3]], "t": [1, [1], []]}),
        ("__import__('os')", None),
        ("array([1], dtype=evil)", None),
        ("[1", None),
        ("[1)", None),
        ("{'a': lambda: 1}", None),
        ("x", None),
    ],
)
def test_literals_become_json(text, value):
    found = sketch.as_json(text)
    assert (None if found is None else json.loads(found)) == value


def test_split_end_to_end(spark):
    table = "{'header': ['City', 'city', ' '], 'types': ['text', 'real', 'text'], 'rows': [['a', 1.5, 'x'], ['b', 2, None]], 'name': 'places'}"
    good = "{'sel': 1, 'agg': 5, 'conds': {'column_index': [], 'operator_index': [], 'condition': []}}"
    every = "{'sel': 0, 'agg': 0, 'conds': {'column_index': [1], 'operator_index': [1], 'condition': ['1']}}"
    rows = [(1, table, good, " Which  mean? "), (2, table, every, "Which ones?"), (3, table, good, "  "), (4, table, good.replace("'sel': 1", "'sel': True"), "q"), (5, table.replace("'real'", "'blob'"), good, "q"), (6, None, good, "q"), (7, table, good.replace("'condition': []", "'condition': ['x']"), "q")]
    kept, refused = sketch.normalized_split(spark.createDataFrame(rows, "k int, t string, s string, q string"), "t", "s", "q", "k", "dev")
    got = {r["id"]: r for r in kept.collect()}
    assert got["dev-1"]["answer"] == ["1.75"] and got["dev-1"]["question"] == "Which mean?" and got["dev-2"]["answer"] == ["a", "b"]
    assert got["dev-1"]["table"]["headers"] == ["City", "city__2", "column_3"] and got["dev-1"]["schema"].startswith('CREATE TABLE "places" (\n  "City" TEXT,')
    errors = {r["k"]: r["error"] for r in refused.collect()}
    assert errors == {3: "no question", 4: "column out of range", 5: "header and types do not agree", 6: "not a literal table", 7: "conditions do not agree in length"}


@pytest.mark.parametrize(
    ("answer", "error"),
    [
        ("[1]", "not_an_object"),
        ("{}", "four_candidates_expected"),
        ('{"candidates": [1, 2, 3, 4]}', "candidate_not_an_object"),
        (json.dumps({"candidates": [{"id": "c", "style": s, "question": "q"} for s in creative.STYLES]}), "candidate_ids"),
        (json.dumps({"candidates": [{"id": f"c{i}", "style": "direta", "question": "q"} for i in range(4)]}), "candidate_styles"),
        (None, "invalid_json"),
    ],
)
def test_writer_errors(spark, answer, error):
    got = creative.writer_candidates(spark.createDataFrame([("a", answer)], "id string, response string")).first()
    assert got["error"] == error and got["candidates"] is None


def _writer(question="Quantos filmes da categoria Action existem?"):
    return json.dumps({"candidates": [{"id": f"c{i}", "style": s, "question": question if i else "curta?"} for i, s in enumerate(creative.STYLES)]})


def test_creative_chain(spark):
    brief = "struct<aggregation:string,literal_values:array<string>>"
    briefs = spark.createDataFrame([("w-1", ("COUNT", ["action"])), ("w-2", ("AVG", ["Action"])), ("w-3", ("COUNT", []))], f"id string, brief {brief}")
    answers = spark.createDataFrame([("w-1", "```json\n" + _writer() + "\n```"), ("w-2", _writer()), ("w-3", "no json")], "id string, response string")
    judged = creative.judged_candidates(answers, briefs)
    errors = {(r["id"], r["candidate_id"]): r["error"] for r in judged.collect()}
    assert errors[("w-1", "c0")] == "shape" and errors[("w-1", "c1")] is None and errors[("w-2", "c1")] == "missing_aggregation" and errors[("w-3", None)] == "invalid_json"
    jobs, rejected = creative.roundtrip_jobs(judged)
    assert {r["id"] for r in jobs.collect()} == {"w-1:c1", "w-1:c2", "w-1:c3"} and rejected.count() == 1 + 4 + 1 + 2
    groups = creative.approved_groups(jobs.withColumn("approved", F.lit(True)))
    critic = spark.createDataFrame([("w-1", json.dumps({"selected_id": "c2", "semantic_fidelity": 5, "naturalness": 4, "clarity": 5, "reason": "ok"}))], "writer_job_id string, response string")
    choices = creative.critic_choices(critic, groups)
    items = spark.createDataFrame([("w-1", "CREATE TABLE t(a)", "SELECT 1", "train")], "id string, schema string, sql string, source_split string")
    final = creative.final_records(choices, groups, items, "system").first()
    assert final["question"].startswith("Quantos") and [m["role"] for m in final["messages"]] == ["system", "user", "assistant"]
    bad = creative.critic_choices(critic.withColumn("response", F.lit('{"selected_id": "c2", "semantic_fidelity": true, "naturalness": 4, "clarity": 5, "reason": "x"}')), groups).first()
    assert bad["error"] == "score"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"two\nlines ""quoted"""\n', encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "a.csv")).first().asDict() == {"id": "1", "text": 'two\nlines "quoted"'}
    (tmp_path / "b.jsonl").write_text('{"id": "a"}\n\n{"id": "a"}\n')
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id string", "id")
    df = spark.createDataFrame([(1, "b"), (0, "a")], "pos int, text string")
    line = F.to_json(F.struct("pos", "text"))
    assert files.write_jsonl(df, str(tmp_path / "out"), "pos") == corpus.fingerprint(df, line, F.col("pos")).first()[0]
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"pos":0,"text":"a"}', '{"pos":1,"text":"b"}']
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_jsonl(df, str(tmp_path / "out"), "pos")
    files.append_jsonl(df, str(tmp_path / "log"))
    done = files.read_jsonl(spark, str(tmp_path / "log"), "pos int, text string")
    assert corpus.pending(spark.createDataFrame([(1,), (5,)], "pos int"), done, "pos").collect()[0]["pos"] == 5
    files.write_manifest(spark, str(tmp_path / "m"), {"n": 1})


def test_session(spark, sf_dir):
    register(spark, sf_dir, ["nation", "region"])
    schemas = {"nation": table_schema(spark, "nation")}
    replies = iter([["SELECT x FROM region"], ["SELECT nope FROM nation"], ["<think>t</think>SELECT count(*) AS n FROM nation"]])
    state, result = session.answer(spark, "Quantas nações?", schemas, lambda m: next(replies))
    assert state.stage == session.Stage.FINALIZED and state.repairs == 2 and result.rows == ((25,),)
    state, result = session.answer(spark, "Apague", schemas, lambda m: ["DELETE FROM nation"], max_repairs=0)
    assert state.stage == session.Stage.BLOCKED and result is None
    with pytest.raises(ValueError):
        session.Session("  ")
    with pytest.raises(RuntimeError):
        session.Session("q").note("accepted", "SELECT 1")
    with pytest.raises(ValueError):
        session.author_messages("q", "ddl", error="e")
    with pytest.raises(RuntimeError):
        session.distinct_candidates(["<think>x</think>", " "], 2)


def test_session_moves():
    """Every event in every stage: as the table says, or refused; repairs end at their limit."""
    for stage in session.Stage:
        for event in ("schemas", "accepted", "refused", "invalid", "closed", "ran", "failed"):
            s = session.Session("q", 1, stage)
            if (stage, event) in session.MOVES:
                assert s.note(event, "x") == {session.MEND: session.Stage.REPAIRING}.get(session.MOVES[stage, event], session.MOVES[stage, event])
            else:
                with pytest.raises(RuntimeError):
                    s.note(event, "x")
    s = session.Session("q", 1)
    for event in ("schemas", "invalid", "accepted", "failed"):
        s.note(event, event)
    assert s.stage == session.Stage.BLOCKED and s.repairs == 1 and s.reason == "repair limit reached"


def test_pack_prompt():
    system, user = session.pack_messages(" Quantos? ", Catalog.load(CATALOG), "cellar", "s", "{dialect}|{schema}|{question}")
    assert system == {"role": "system", "content": "s"} and user["content"].startswith("sqlite|-- catalog: winery") and user["content"].endswith("|Quantos?")


def test_specs_are_sound_and_run(spark, sf_dir):
    tables = ["region", "nation", "customer", "supplier", "orders", "lineitem", "part", "events"]
    register(spark, sf_dir, tables)
    made = specs.expand(spark, specs.FAMILIES).cache()
    assert made.count() == 732 and made.select("family").distinct().count() == 51 and specs.defects(made).isEmpty()
    frozen = made.limit(1).select(F.upper("question").alias("question"))
    assert specs.defects(made, frozen).first()["defect"] == "frozen_question"
    one = made.where("id LIKE '%-001-p%'")  # the first of each grid
    ran = specs.executed(one, lambda sql: execute.run(spark, sql, tables, timeout_ms=30_000))
    assert ran.where("not executed").count() == 0 and ran.count() == one.count()


def test_memo_by_canonical_form(spark):
    seen = []
    df = spark.createDataFrame([("SELECT a FROM t",), ("select  a\nfrom t",), ("SELECT b FROM t",), ("((",), ("(((",)], "q string")
    from millrace.plans import analyze

    out = analyze.with_analysis(df, "q", lambda q: (seen.append(q) or len(seen),), "n int", lambda q: analyze.canonical(spark, q))
    assert len(seen) == 4 and out.select("n").distinct().count() == 4


def test_work_budget(spark, sf_dir):
    register(spark, sf_dir, ["lineitem"])
    assert "work_budget" in execute.run(spark, "SELECT count(*) FROM lineitem", ["lineitem"], max_bytes=100).error
    assert execute.run(spark, "SELECT count(*) FROM lineitem", ["lineitem"], max_bytes=1 << 30).executed


def test_command_line(spark, sf_dir, capsys, tmp_path):
    from millrace.__main__ import main

    assert main(["check", "DELETE FROM x"]) == 1
    assert main(["run", "SELECT count(*) AS n FROM region", "--data", sf_dir, "--tables", "region"]) == 0
    assert '"rows": [[5]]' in capsys.readouterr().out
    (tmp_path / "c.json").write_text(CATALOG)
    assert main(["render", str(tmp_path / "c.json"), "cellar"]) == 0
    assert main(["match", "SELECT a FROM t", "select a from t"]) == 0 and main(["match", "SELECT a FROM t", "select b from t"]) == 1
    assert main(["complexity", "SELECT a FROM t ORDER BY a"]) == 0 and main(["rank", "Quantos?", "SELECT count(*) FROM t", "SELECT 1"]) == 0
    assert main(["schema", "orders", "--data", sf_dir, "--tables", "orders"]) == 0
    assert "-- o_orderstatus: F, O, P" in capsys.readouterr().out
    docs = f"{sf_dir}/documents.parquet"
    assert main(["fingerprint", docs, "text", "doc_id"]) == 0 and main(["split", docs, "text", str(tmp_path / "s"), "10"]) == 0
    assert main(["mysql", "SELECT IFNULL(a, 0) FROM t LIMIT 5, 10"]) == 0
    assert "SELECT coalesce(a, 0) FROM t LIMIT 10 OFFSET 5" in capsys.readouterr().out
