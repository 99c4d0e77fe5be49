"""Large CSV files, batches appended once, keys and references found in data, prepared mirrors, value hints."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import catalog, discover, files, mirror, shared


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _field(rng):
    text = "".join(rng.choice(["a", "bé", " ", '""', "\n", "\r\n", ",", "x" * 40]) for _ in range(rng.randrange(12)))
    return f'"{text}"' if any(c in text for c in '",\n') or rng.random() < 0.3 else text.strip()


@pytest.mark.parametrize(("end", "mark"), [("\n", "﻿"), ("\r\n", ""), ("\n", "")])
def test_csv_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_blocks, end, mark):
    rng = random.Random(len(end) + len(mark))
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("one.csv", "two.csv"):
        rows = [f'{i},{_field(rng)},"{name}",{_field(rng)}' for i in range(6000)]
        rows[100] = '100,"' + "long\n" * 30_000 + '",x,y'  # over several blocks
        rows.insert(50, "")
        (folder / name).write_bytes((mark + 'id,"te,xt",name,rest' + end + end.join(rows) + (end if name == "one.csv" else "")).encode())
    got = files.read_large_csv(spark, str(folder))
    want = files.read_csv(spark, str(folder))
    assert files._lines(spark, str(folder)).rdd.getNumPartitions() > 8 and got.columns == want.columns == ["id", "te,xt", "name", "rest"]
    assert got.count() == want.count() == 12_000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_csv_records_of_small_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert files.read_large_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    assert files.read_large_csv(spark, str(tmp_path / "head.csv")).columns == ["a", "b"]
    (tmp_path / "one.csv").write_text('a,b\n1,"x\n\ny"\n\n2,')
    assert [tuple(r) for r in files.read_large_csv(spark, str(tmp_path / "one.csv"), "a int, b string").orderBy("a").collect()] == [(1, "x\n\ny"), (2, None)]
    assert [r["record"] for r in files.csv_records(spark, str(tmp_path / "one.csv")).orderBy("record").collect()] == [0, 1, 2, 3]


def test_a_batch_is_appended_once(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "answers"), "id long, text string"
    df = spark.range(5).select("id", F.lit("x").alias("text"))
    assert files.read_batches(spark, path, schema).count() == 0
    assert files.append_batch(df, path, "a/1") and not files.append_batch(df, path, "a/1")
    assert files.read_batches(spark, path, schema).count() == 5

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # the driver dies after the rows are written and before the entry is made
        m.setattr(files, "_entered", crash)
        with pytest.raises(RuntimeError):
            files.append_batch(df, path, "b")
    assert files.read_batches(spark, path, schema).count() == 5
    assert files.append_batch(df, path, "b")
    got = files.read_batches(spark, path, schema)
    assert {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()} == {"a/1": 5, "b": 5}
    fs, entry = shared.files(spark, f"{path}/_ledger/c.json")
    assert files._entered(fs, entry, {"batch": "c", "folder": "x"}) and not files._entered(fs, entry, {"batch": "c", "folder": "y"})  # of two runs at once, one wins
    with pytest.raises(ValueError):
        files.append_batch(df, path, "")


def test_value_sets_in_one_scan(spark):
    df = spark.range(1000).select((F.col("id") % 25).alias("a"), (F.col("id") % 26).alias("b"), "id", F.lit(None).cast("string").alias("n"), F.when(F.col("id") % 2 == 0, "x").alias("h")).repartition(6)
    rows, sets = catalog.value_sets(df, ["a", "b", "id", "n", "h"])
    assert rows == 1000 and sets == {"a": sorted(str(i) for i in range(25)), "n": [], "h": ["x"]}
    assert catalog.value_sets(df, []) == (1000, {}) and catalog.value_sets(df.where("id < 0"), ["a"]) == (0, {"a": []})
    df.createOrReplaceTempView("hinted")
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    spark.sparkContext.setJobGroup("hints", "")
    text = catalog.table_schema(spark, "hinted", hints={"hinted": ("a", "b", "h")})
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert "-- rows: 1000" in text and "-- h: x" in text and "-- b:" not in text
    assert len(tracker.getJobIdsForGroup("hints")) <= 3  # adaptive execution runs a query's stages as jobs; one of them scans


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages")


def test_discovery_on_the_test_tables(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    found = discover.discovered("shop", tables)
    keys = {t.name: t.primary_key for t in found.tables.values()}
    for table, key in {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id"}.items():
        assert keys[table] == (key,)
    edges = {(r.from_table, r.from_columns[0], r.to_table) for r in found.relationships}
    assert {("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier")} <= edges
    assert edges - {("labels", "doc_id", "documents"), ("documents", "doc_id", "labels")} == {e for e in edges if e[1].partition("_")[2] == e[2][:0] + {"region": "regionkey", "nation": "nationkey", "customer": "custkey", "orders": "orderkey", "part": "partkey", "supplier": "suppkey"}.get(e[2], "")}
    integrity = found.integrity(tables)
    assert integrity.where("violations > 0").isEmpty()


def test_discovery_of_keys_and_orphans(spark):
    a = spark.createDataFrame([(i, i // 3, i % 3, "x", None if i == 4 else i) for i in range(60)], "a_id int, a_group int, a_step int, a_kind string, a_null int")
    assert discover.key(a, discover.profile("a", a)) == ("a_id",)
    b = a.drop("a_id")
    assert discover.key(b, discover.profile("a", b)) == ("a_group", "a_step")
    assert discover.key(b.drop("a_step"), discover.profile("a", b.drop("a_step"))) == ()
    empty = a.where("a_id < 0")
    assert discover.key(empty, discover.profile("a", empty)) == ()
    parent = spark.createDataFrame([(i,) for i in range(20)], "p_group int")
    tables = {"a": a, "p": parent}
    columns = {t: discover.profile(t, df) for t, df in tables.items()}
    keys = {"a": ("a_id",), "p": ("p_group",)}
    assert [(r.from_table, r.from_columns, r.to_table) for r in discover.references(tables, columns, keys)] == []  # one column has no prefix to drop
    wide = parent.withColumn("p_name", F.lit("n"))
    found = discover.references({"a": a, "p": wide}, {"a": columns["a"], "p": discover.profile("p", wide)}, keys)
    assert [(r.from_table, r.from_columns, r.to_table) for r in found] == [("a", ("a_group",), "p")]
    short = wide.where("p_group <> 7")
    assert discover.references({"a": a, "p": short}, {"a": columns["a"], "p": discover.profile("p", short)}, keys) == []


def _shop():
    return catalog.Catalog(
        "shop",
        "spark",
        {"orders": catalog.Table("orders", (("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT")), ("o_orderkey",)), "customer": catalog.Table("customer", (("c_custkey", "BIGINT"),), ("c_custkey",))},
        (catalog.Relationship("orders", ("o_custkey",), "customer", ("c_custkey",)),),
    )


def test_mirror_without_exchange_and_rolled_back(spark, sf_dir, tmp_path):
    path, deal = str(tmp_path / "mirror"), {"orders": "o_custkey", "customer": "c_custkey"}
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in deal}
    with pytest.raises(FileNotFoundError):
        mirror.register(spark, path)
    assert mirror.prepare(spark, path, tables, _shop(), deal, buckets=4) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = mirror.register(spark, path)
        joined = made["orders"].join(made["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == tables["orders"].count()
    broken = tables | {"customer": tables["customer"].where("c_custkey % 7 <> 0")}
    with pytest.raises(mirror.IntegrityError, match="orphans"):
        mirror.prepare(spark, path, broken, _shop(), deal, buckets=4)
    assert [v["version"] for v in mirror.versions(spark, path)] == [1] and not (tmp_path / "mirror" / "v2").exists()
    assert mirror.prepare(spark, path, tables, _shop(), deal, buckets=2) == 2
    for name in deal:  # a session that did not write the tables
        spark.sql(f"DROP TABLE {mirror._table(name, path, 2)}")
    again = mirror.register(spark, path)
    assert again["customer"].count() == tables["customer"].count() and mirror.register(spark, path, 1)["orders"].count() == tables["orders"].count()
