"""Names that clash, buckets that are not listed, whole-catalog execution, and functions that only callers outside use."""

import json

import pytest
from pyspark.sql import functions as F

from millrace import more_queries
from millrace.functions import names
from millrace.operators import collate, corpus
from millrace.plans import analyze, execute
from millrace.sources import files
from millrace.sources.catalog import Catalog, Pack, Table, register


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Key int, _key int")
    assert names.free(df, "key", "rank", "rank") == ["__key", "rank", "_rank"]


def test_helper_columns_leave_the_input_alone(spark):
    rows = [(i, "ab"[i % 2], f"k{i}", f"r{i}", f"h{i}", f"_k{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, bucket string, key string, rank string, hash string, _key string")
    frozen = df.where("id < 5")
    samples = [
        corpus.stratified_sample(df, "bucket", F.sha2(F.col("id").cast("string"), 256), 10, ["a", "b"]),
        corpus.tier_quota(df, "bucket", F.sha2("key", 256), {"a": 50, "b": 50}, 10),
        corpus.top_by_hash(df, [F.col("key")], 10),
        corpus.oversampled(df, 10, 2, 1, F.col("id") >= 0, F.col("key")),
        corpus.overlapping(df, F.col("key"), frozen, F.col("key")),
        corpus.without_overlap(df, F.col("key"), frozen, F.col("key")),
    ]
    known = {r[0]: r for r in rows}
    for out in samples:
        assert out.columns == df.columns
        found = out.collect()
        assert found and all(tuple(r) == known[r["id"]] for r in found)
    assert samples[4].count() == 5 and samples[5].count() == 35 and samples[0].count() == 10
    ranked = corpus.ranked(df.withColumn("part", F.lit("p")), "id")
    assert ranked.columns == [*df.columns, "part", "rank"] or ranked.columns[-1] == "rank"
    with pytest.raises(ValueError):
        collate.collated(spark.createDataFrame([(1, 1)], "id int, batch int"), "e", "id", 2)


def test_examples_keep_columns_of_helper_names(spark):
    df = spark.createDataFrame([(i, [1] * (i + 1), [2] * 2, "s", "w") for i in range(4)], "id int, p array<int>, a array<int>, size string, width string")
    made = collate.collated(df.select("id", "size", "width", collate.example(F.col("p"), F.col("a")).alias("e")), "e", "id", 2)
    assert made.columns == ["id", "size", "width", "batch", "input_ids", "labels", "attention_mask"]
    assert {r["id"]: len(r["input_ids"]) for r in made.collect()} == {0: 4, 1: 4, 2: 6, 3: 6} and made.where("size <> 's' OR width <> 'w'").isEmpty()


def test_buckets_that_are_not_listed_come_last(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(["a"] * 8 + ["z"] * 8 + [None] * 8)], "id int, bucket string")
    got = corpus.stratified_sample(df, "bucket", F.sha2(F.col("id").cast("string"), 256), 11, ["a"])
    assert {r["bucket"]: r["count"] for r in got.groupBy("bucket").count().collect()} == {"a": 5, "z": 3, None: 3}
    few = corpus.stratified_sample(df.where("bucket IS NULL OR id < 2"), "bucket", F.sha2(F.col("id").cast("string"), 256), 9, ["a", "q"])
    assert {r["bucket"]: r["count"] for r in few.groupBy("bucket").count().collect()} == {"a": 2, None: 7}


def test_execution_within_a_pack(spark, sf_dir):
    register(spark, sf_dir, ["region", "nation"])
    made = Catalog("shop", "spark", {t: Table(t, ((f"{t[0]}_name", "STRING"),)) for t in ("region", "nation")}, packs={"places": Pack("places", "small", ("region",))})
    assert execute.validate_and_execute(spark, "SELECT count(*) FROM region", made, "places").rows == ((5,),)
    assert "out_of_scope" in execute.validate_and_execute(spark, "SELECT count(*) FROM nation", made, "places").error


def test_items_of_a_json_array(spark, tmp_path):
    path = str(tmp_path / "items.json")
    (tmp_path / "items.json").write_text(json.dumps([{"id": 2, "split": "test", "q": "b"}, {"id": 1, "split": "test", "q": "a"}, {"id": 3, "split": "train", "q": ""}]))
    schema = "id int, split string, q string"
    assert [r["id"] for r in files.read_items(spark, path, schema, "split = 'test'", ["q"], 2).collect()] == [1, 2]
    for where, count in (("split = 'test'", 3), ("split = 'train'", 1)):  # another number of them, an empty field
        with pytest.raises(ValueError):
            files.read_items(spark, path, schema, where, ["q"], count)


def test_plans_and_names(spark, sf_dir):
    register(spark, sf_dir, ["nation"])
    assert analyze.equivalent_plan(spark, "SELECT n_name FROM nation WHERE n_nationkey > 1 AND n_regionkey = 2", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 1")
    assert not analyze.equivalent_plan(spark, "SELECT n_name FROM nation", "SELECT n_comment FROM nation" if "n_comment" in spark.table("nation").columns else "SELECT n_regionkey FROM nation")
    assert analyze.strictly_valid(spark, "SELECT n_name FROM nation") and not analyze.strictly_valid(spark, "SELECT nome FROM nation")


def test_a_seeded_order(spark):
    df = spark.range(50)
    one = [r["id"] for r in corpus.shuffled(df, 1, F.col("id").cast("string")).collect()]
    assert one == [r["id"] for r in corpus.shuffled(df.repartition(7), 1, F.col("id").cast("string")).collect()]
    assert sorted(one) == list(range(50)) and one != sorted(one) and one != [r["id"] for r in corpus.shuffled(df, 2, F.col("id").cast("string")).collect()]


def test_texts_are_worked_on_at_once(spark):
    import threading

    gate = threading.Barrier(4, timeout=30)
    df = spark.createDataFrame([(f"SELECT {i}",) for i in range(4)], "q string")
    out = analyze.with_analysis(df, "q", lambda q: (gate.wait() * 0 + len(q),), "n int", threads=4)  # each waits for the three others
    assert out.where("n = length(q)").count() == 4


def test_a_view_leaves_nothing_behind(spark, sf_dir):
    more_queries.view_scan(spark, sf_dir).collect()
    assert "sales_by_flag" not in [t.name for t in spark.catalog.listTables()]


def test_folded_keys(spark):
    from millrace.functions.text import folded_key

    letters = [chr(c) for c in [*range(0x21, 0x1100), *range(0x1E00, 0x2000), *range(0xFB00, 0xFB18)] if c not in (0x131, 0x85, 0xA0) and chr(c) == chr(c).strip()]
    got = spark.createDataFrame([(x,) for x in letters], "x string").select("x", folded_key(F.col("x")).alias("k")).collect()
    wrong = [r["x"] for r in got if r["k"] != r["x"].casefold() and r["x"].isalpha()]
    assert not wrong, wrong
    words = spark.createDataFrame([("  STRASSE  x",), ("Straße X",), ("ΟΔΟΣ",), ("οδος",)], "x string").select(folded_key(F.col("x")).alias("k"))
    assert [r["k"] for r in words.collect()] == ["strasse x", "strasse x", "οδοσ", "οδοσ"]


def test_more_commands(spark, sf_dir, capsys, tmp_path):
    from millrace.__main__ import COMMANDS, main

    assert len(COMMANDS) == 26
    ddl = "CREATE TABLE t (a INT, b TEXT)"
    assert main(["strict", "SELECT b FROM t", ddl]) == 0 and main(["strict", "SELECT c FROM t", ddl]) == 1
    assert main(["postgres", "SELECT a::text FROM public.t"]) == 0 and main(["sqlite", "SELECT strftime('%Y', d) FROM t"]) == 0
    said = capsys.readouterr().out
    assert "SELECT a::STRING FROM t" in said and "unresolved_column" in said and "year(to_timestamp(d))" in said
    assert main(["discover", "--data", sf_dir, "--tables", "region,nation"]) == 0
    assert '"from_columns": ["n_regionkey"]' in capsys.readouterr().out
    (tmp_path / "x.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert main(["csv", str(tmp_path / "x.csv"), str(tmp_path / "x.parquet")]) == 0
    for _ in range(2):
        assert main(["append", str(tmp_path / "x.parquet"), str(tmp_path / "answers"), "one"]) == 0
    said = capsys.readouterr().out
    assert '"rows": 2' in said and '"appended": true' in said and '"appended": false' in said
    texts = spark.createDataFrame([("SELECT 1",), ("((",), ("SELECT 2",)], "q string")
    texts.write.parquet(str(tmp_path / "texts"))
    assert main(["verdicts", str(tmp_path / "texts"), "q", str(tmp_path / "store")]) == 0
    assert '"accepted": 2' in capsys.readouterr().out
    spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x")], "id int, side string, v string").write.parquet(str(tmp_path / "pairs"))
    assert main(["pairs", str(tmp_path / "pairs"), "id", "side"]) == 1
    assert '"equal": 1, "different": 1' in capsys.readouterr().out
