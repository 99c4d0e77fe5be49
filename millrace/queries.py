"""Registered queries over the test tables, and their SQL for the oracle.

Relational queries are SQL texts that pass the read-only gate and the scope check
before Catalyst plans them.  Corpus, comparison and sketch queries call the
operators of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import corpus_queries, more_queries
from .operators import compare, corpus, sketch
from .plans import gate
from .sources.catalog import register, register_dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def governed(spark: SparkSession, sf_dir: str, sql: str, args: dict | None = None, dealt: dict[str, str] | None = None) -> DataFrame:
    """A gated query as a DataFrame over the tables of a folder, those of ``dealt`` dealt by the key it names."""
    verdict = gate.check(spark, sql)
    if not verdict.allowed:
        raise PermissionError(verdict.reason)
    used = gate.relations(spark, verdict.normalized_sql)
    if outside := [r for r in used if r not in TABLES]:
        raise PermissionError(f"out of scope: {outside}")
    dealt = dealt or {}
    register(spark, sf_dir, [t for t in used if t not in dealt])
    for table, key in dealt.items():
        register_dealt(spark, sf_dir, table, key)
    return spark.sql(verdict.normalized_sql, args=args) if args else spark.sql(verdict.normalized_sql)


#: Exact whatever the order of additions: terms are decimals before they are summed.
REVENUE = "CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS decimal(18, 4))), 2) AS double)"
FLAGSHIP = f"""SELECT n_name AS nation, {REVENUE} AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY revenue DESC, nation LIMIT 20"""

#: name -> SQL that both engines read alike.
SHARED = {
    "flagship_revenue_by_nation": FLAGSHIP,
    "scan_project_filter": "SELECT o_orderkey, o_totalprice AS total FROM orders WHERE o_totalprice > 300000.0 AND o_orderstatus = 'F'",
    "computed_projection": "SELECT doc_id, cast(length(text) AS bigint) AS text_length FROM documents WHERE lang = 'en'",
    "filter_between": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 950.0 AND 1050.0",
    "filter_ilike": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'S%RING'",
    "filter_null_neq": "SELECT count(*) AS described FROM documents WHERE text IS NOT NULL AND text <> ''",
    "filter_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_comparisons": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_discount < 0.05 AND l_tax > 0.01 GROUP BY l_returnflag",
    "arithmetic_round": f"SELECT l_returnflag, l_linestatus, {REVENUE} AS revenue, round(avg(l_extendedprice + l_tax), 2) AS mean_price FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "order_by_unprojected": "SELECT p_brand AS brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 7",
    "join_inner_using": "SELECT n_name, region_name, count(*) AS suppliers FROM (SELECT r_regionkey AS k, r_name AS region_name FROM region) r JOIN (SELECT n_regionkey AS k, n_name, n_nationkey FROM nation) n USING (k) JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name, region_name",
    "join_inner_on_chain": f"""SELECT r_name AS region, c_mktsegment AS segment, p_brand AS brand, {REVENUE} AS revenue, count(DISTINCT o_orderkey) AS orders
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE p_size >= 4 AND s_acctbal > 0 GROUP BY r_name, c_mktsegment, p_brand""",
    "left_join_zero_counts": "SELECT n_name AS nation, count(s_suppkey) AS suppliers FROM nation LEFT JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 8000) s ON s_nationkey = n_nationkey GROUP BY n_name",
    "left_join_residual_on": "SELECT c_custkey, count(o_orderkey) AS small_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice <= 20000.0 GROUP BY c_custkey",
    "left_join_filter": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY c_custkey",
    "join_composite_key": "SELECT count(*) AS pairs FROM (SELECT l_orderkey AS k, l_linenumber AS m, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) a JOIN (SELECT DISTINCT l_orderkey AS k, l_linenumber AS m FROM lineitem WHERE l_discount > 0.05) b ON a.k = b.k AND a.m = b.m",
    "cte_preaggregate_join": """WITH line_totals AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_orderkey),
customer_totals AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders)
SELECT c_mktsegment AS segment, CAST(round(sum(CAST(total AS decimal(18, 4))), 2) AS double) AS lines_total, count(*) AS orders FROM customer_totals JOIN line_totals ON customer_totals.k = line_totals.k JOIN customer ON c_custkey = c GROUP BY c_mktsegment""",
    "agg_count_star": "SELECT count(*) AS lines FROM lineitem",
    "agg_count_column": "SELECT o_orderstatus AS status, count(o_totalprice) AS priced FROM orders GROUP BY o_orderstatus",
    "agg_count_distinct": "SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "agg_sum_avg": "SELECT l_linestatus AS status, CAST(round(sum(CAST(l_quantity AS decimal(18, 4))), 2) AS double) AS quantity, round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY l_linestatus",
    "agg_sum_empty": "SELECT sum(l_quantity) AS quantity, count(*) AS n FROM lineitem WHERE l_quantity < 0",
    "agg_min_max": "SELECT p_brand AS brand, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part GROUP BY p_brand",
    "group_by_alias_month": "SELECT substring(CAST(date_trunc('month', o_orderdate) AS varchar(30)), 1, 7) AS month, count(*) AS orders FROM orders GROUP BY month",
    "group_by_date": "SELECT CAST(CAST(ts AS date) AS varchar(10)) AS day, count(*) AS events, CAST(round(sum(CAST(value AS decimal(18, 4))), 2) AS double) AS value FROM events GROUP BY CAST(ts AS date)",
    "extract_day": "SELECT CAST(extract(DAY FROM o_orderdate) AS bigint) AS day_of_month, count(*) AS orders FROM orders GROUP BY CAST(extract(DAY FROM o_orderdate) AS bigint)",
    "month_year": "SELECT CAST(year(o_orderdate) AS bigint) AS y, CAST(month(o_orderdate) AS bigint) AS m, count(*) AS orders FROM orders GROUP BY 1, 2",
    "interval_filter": "SELECT count(*) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate - o_orderdate > INTERVAL '30' DAY",
    "select_distinct": "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer",
    "value_domain_topk": "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 5",
    "topk_tiebreak": "SELECT c_name AS customer, CAST(round(sum(CAST(o_totalprice AS decimal(18, 4))), 2) AS double) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY spent DESC, customer LIMIT 20",
    "order_mixed": "SELECT n_name AS nation, n_regionkey AS region FROM nation ORDER BY n_regionkey ASC, n_name DESC",
    "order_by_ordinal": "SELECT r_name AS region, r_regionkey AS k FROM region ORDER BY 2 DESC",
    "scalar_subquery_profile": "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines",
    "row_cap": "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey) AS t ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "derived_table": "SELECT segment, round(avg(orders), 4) AS mean_orders FROM (SELECT c_mktsegment AS segment, c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey) t GROUP BY segment",
    "coalesce_cast": "SELECT CAST(n_nationkey AS varchar(10)) AS key_text, coalesce(n_name, '?') AS nation FROM nation",
    "heavy_eight_relations": f"""SELECT r_name AS region, count(DISTINCT o_orderkey) AS orders, count(DISTINCT p_partkey) AS parts, {REVENUE} AS revenue
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN (SELECT n_nationkey AS sn, n_name AS supplier_nation FROM nation) s ON sn = s_nationkey WHERE l_quantity >= 40 GROUP BY r_name""",
    "window_pass_through": "SELECT nation, customer, balance FROM (SELECT n_name AS nation, c_name AS customer, c_acctbal AS balance, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON n_nationkey = c_nationkey) t WHERE rn <= 3",
    "set_operations_pass_through": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0",
    "exists_pass_through": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000.0)",
}

#: name -> tables dealt by key: counts of distinct orders keep a row an order and group in memory, for all lines of a task.
DEALT = {"join_inner_on_chain": {"lineitem": "l_orderkey"}, "heavy_eight_relations": {"lineitem": "l_orderkey"}}

#: name -> (Spark SQL, SQL of the oracle) where the dialects differ.
PAIRS = {
    "array_contains_filter": (
        "SELECT p_partkey, p_name FROM part WHERE array_contains(split(lower(p_name), ' '), 'red')",
        "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'red')",
    ),
    "range_bounds": (
        "SELECT user_id, period.lower AS first_seen, period.upper AS last_seen FROM (SELECT user_id, named_struct('lower', min(ts), 'upper', max(ts)) AS period FROM events GROUP BY user_id) t WHERE period.upper - period.lower > INTERVAL '20' DAY",
        "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) - min(ts) > INTERVAL '20' DAY",
    ),
    "lenient_cast": (
        "SELECT try_cast(substring(c_name, CAST(7 + c_custkey % 6 AS int), 3) AS int) AS code, count(*) AS n FROM customer GROUP BY 1",
        "SELECT try_cast(substring(c_name, CAST(7 + c_custkey % 6 AS int), 3) AS int) AS code, count(*) AS n FROM customer GROUP BY 1",
    ),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(spark, sf_dir, FLAGSHIP)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(spark, sf_dir, "SELECT o_orderpriority AS priority, count(*) AS orders FROM orders WHERE o_totalprice > :least GROUP BY o_orderpriority", {"least": 100000.0})


def dedup_before_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A soft relation: the right side is reduced to one row a key before the join."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    orders = _table(spark, sf_dir, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.min("first_ship").alias("first_ship"))


def corpus_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import collapse, line_ends

    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(collapse(F.col("text")), 256).alias("collapsed"), F.sha2(line_ends(F.col("text")), 256).alias("lined"))


def corpus_reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.rejection_histogram(_table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id", 8000)


def corpus_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.dedup_exact(_table(spark, sf_dir, "documents"), ["text"], "doc_id").select("doc_id", "lang", "source")


def corpus_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.group_split(_table(spark, sf_dir, "documents"), F.col("text"), 10).select("doc_id", "schema_group", "split")


def corpus_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups on both sides after a split by rows instead of groups: what the check must find."""
    docs = _table(spark, sf_dir, "documents").withColumn("schema_group", F.sha2("text", 256))
    rows = docs.withColumn("split", F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train"))
    return corpus.leaking_groups(rows)


def corpus_family_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.family_holdout(_table(spark, sf_dir, "documents"), "source", ["src3", "src7"]).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


def corpus_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact rule: question keys that stand in the benchmark (documents and benchmark lines)."""
    from .functions.text import question_key

    bench = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return corpus.overlapping(lines, question_key(F.col("line")), bench, question_key(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


def corpus_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return corpus.stratified_sample(docs, "lang", F.sha2(F.col("doc_id").cast("string"), 256), 350, ["es", "de", "fr", "en"]).select("doc_id", "lang")


def corpus_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return corpus.top_by_hash(docs.select("doc_id", "lang"), [F.lit("train"), F.col("doc_id").cast("string")], 100)


def corpus_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = corpus.collect_ordered(_table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"], "messages")
    joined = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["text"])), "\n")
    return turns.select("conv_id", F.size("messages").cast("bigint").alias("turns"), F.sha2(joined, 256).alias("rendered"))


def corpus_resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pending(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


def corpus_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


def metrics_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return corpus.rates(joined, ["quality", "toxic"], ["source"])


def metrics_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    side = F.col("doc_id") % 2
    a, b = (corpus.rates(joined.where(side == k), ["quality"], ["lang"]) for k in (0, 1))
    out = compare.metric_deltas(a, b, ["lang"], ["quality_rate"])
    return out.select("lang", *[F.round(c, 9).alias(c) for c in ("quality_rate_a", "quality_rate_b", "quality_rate_delta")])


def uniqueness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is not among those of positive balance: orphans of a cut-down parent."""
    parents = _table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return corpus.orphans(_table(spark, sf_dir, "orders"), parents, [("o_custkey", "c_custkey")]).select("o_orderkey")


def multiset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    a = orders.select("o_orderstatus", "o_orderpriority")
    b = orders.where("o_orderkey % 7 <> 0").select("o_orderstatus", "o_orderpriority")
    return compare.multiset_difference(a, b)


def result_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.rows_hash(_table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return corpus.fingerprint(docs, F.col("text"), F.col("doc_id"), levels=2)


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars")
    tier = F.when(size < 500, "small").when(size < 4000, "medium").otherwise("heavy")
    return _table(spark, sf_dir, "documents").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def tier_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars")
    docs = _table(spark, sf_dir, "documents").withColumn("tier", F.when(size < 500, "small").when(size < 4000, "medium").otherwise("heavy"))
    return corpus.tier_quota(docs.select("doc_id", "tier"), "tier", F.sha2(F.col("doc_id").cast("string"), 256), {"small": 60, "medium": 25, "heavy": 15}, 200)


def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region with every paraphrase; ids and texts from templates."""
    rank = F.row_number().over(Window.orderBy("r_name"))  # a handful of rows
    values = _table(spark, sf_dir, "region").select(F.lit("region-customers").alias("family"), rank.alias("row_number"), F.col("r_name").alias("region"))
    asked = [("region-customers", 1, "Quantos clientes há na região {region}?"), ("region-customers", 2, "Conte os clientes da região {region}.")]
    templates = spark.createDataFrame(asked, "family string, template_number int, question string")
    sql = F.lit("SELECT count(*) AS clientes FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = '{region}'")
    out = corpus.expand(values, templates)
    return out.select("id", "family", corpus.fill(F.col("question"), {"region": F.col("region")}).alias("question"), corpus.fill(sql, {"region": F.col("region")}).alias("sql"))


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One private table a nation (its customers), with one sketch for each aggregation and one without."""
    customers = _table(spark, sf_dir, "customer")
    row = F.array(F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal").cast("string"))
    rows = customers.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    table = F.struct(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("id"), F.array(F.lit("Name"), F.lit("Segment"), F.lit("Balance")).alias("headers"), F.array(F.lit("text"), F.lit("text"), F.lit("real")).alias("types"), F.col("rows"))

    def cond(col: int, op: int, value: str):
        return F.struct(F.lit(col).alias("col"), F.lit(op).alias("op"), F.lit(value).alias("value"))

    made = [
        F.struct(F.lit(0).alias("sel"), F.lit(3).alias("agg"), F.array(cond(1, 0, "BUILDING")).alias("conds")),
        F.struct(F.lit(2).alias("sel"), F.lit(1).alias("agg"), F.array(cond(2, 2, "5000")).alias("conds")),
        F.struct(F.lit(2).alias("sel"), F.lit(2).alias("agg"), F.array(cond(1, 0, "MACHINERY"), cond(2, 1, "0")).alias("conds")),
        F.struct(F.lit(2).alias("sel"), F.lit(5).alias("agg"), F.array(cond(2, 1, "100")).alias("conds")),
        F.struct(F.lit(2).alias("sel"), F.lit(4).alias("agg"), F.array(cond(2, 2, "0")).alias("conds")),
        F.struct(F.lit(0).alias("sel"), F.lit(0).alias("agg"), F.array(cond(2, 1, "9000")).alias("conds")),
    ]
    return rows.select("c_nationkey", table.alias("table"), F.posexplode(F.array(*made)).alias("number", "sketch"))


def _shown(number: F.Column, answer: F.Column) -> F.Column:
    """Counts and lists as they are, amounts with two places."""
    money = F.round(answer.try_cast("double"), 2).cast("decimal(18,2)").cast("string")
    return F.when(number.isin(0, 5), answer).otherwise(money).alias("answer")


def sketch_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sketches(spark, sf_dir)
    answer = F.array_join(F.array_sort(sketch.run_sketch(F.col("table"), F.col("sketch"))), ",")
    return found.select(F.col("c_nationkey").alias("nation"), "number", _shown(F.col("number"), answer))


def sketch_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sketches(spark, sf_dir)
    return found.select(F.col("c_nationkey").alias("nation"), "number", sketch.render_sql(F.col("table"), F.col("sketch")).alias("sql"))


def sketch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered SQL run against each record's own table: the answers of the sketches, the hard way."""
    found = _sketches(spark, sf_dir).withColumns({"sql": sketch.render_sql(F.col("table"), F.col("sketch")), "id": F.concat_ws("/", "c_nationkey", "number")})
    ran = sketch.execute_candidates(found, "id", "table", "sql", max_rows=None)
    key, number = F.split("id", "/"), F.element_at(F.split("id", "/"), 2).cast("int")
    answer = F.array_join(F.array_sort(F.transform("rows", lambda r: F.element_at(r, 1))), ",")
    return ran.select(F.element_at(key, 1).cast("bigint").alias("nation"), number.alias("number"), "executed", _shown(number, answer))


#: What each sketch of each nation must answer.
ANSWERS = """WITH n AS (SELECT DISTINCT c_nationkey AS nation FROM customer)
SELECT nation, 0 AS number, (SELECT count(*)::VARCHAR FROM customer WHERE c_nationkey = nation AND c_mktsegment = 'BUILDING') AS answer FROM n
UNION ALL SELECT nation, 1, (SELECT max(c_acctbal)::DECIMAL(18,2)::VARCHAR FROM customer WHERE c_nationkey = nation AND c_acctbal < 5000) FROM n
UNION ALL SELECT nation, 2, (SELECT min(c_acctbal)::DECIMAL(18,2)::VARCHAR FROM customer WHERE c_nationkey = nation AND c_mktsegment = 'MACHINERY' AND c_acctbal > 0) FROM n
UNION ALL SELECT nation, 3, (SELECT round(avg(c_acctbal), 2)::DECIMAL(18,2)::VARCHAR FROM customer WHERE c_nationkey = nation AND c_acctbal > 100) FROM n
UNION ALL SELECT nation, 4, (SELECT round(sum(c_acctbal), 2)::DECIMAL(18,2)::VARCHAR FROM customer WHERE c_nationkey = nation AND c_acctbal < 0) FROM n
UNION ALL SELECT nation, 5, (SELECT coalesce(string_agg(c_name, ',' ORDER BY c_name), '') FROM customer WHERE c_nationkey = nation AND c_acctbal > 9000) FROM n"""

OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "bind_params": (bind_params, "SELECT o_orderpriority AS priority, count(*) AS orders FROM orders WHERE o_totalprice > 100000.0 GROUP BY o_orderpriority"),
    "dedup_before_join": (dedup_before_join, "SELECT o_orderstatus, count(*) AS orders, min(f) AS first_ship FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS f FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1"),
    "corpus_normalize": (corpus_normalize, "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed, sha256(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS lined FROM documents"),
    "corpus_reject_histogram": (
        corpus_reject_histogram,
        """WITH j AS (SELECT text, lang, CASE WHEN coalesce(trim(text), '') = '' OR coalesce(trim(lang), '') = '' THEN 'missing_required_field' WHEN greatest(length(text), length(lang)) > 8000 THEN 'too_long' END AS reason FROM documents)
SELECT reason, count(*) AS rows FROM j WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'accepted', count(*) FROM (SELECT DISTINCT text, lang FROM j WHERE reason IS NULL)
UNION ALL SELECT 'duplicate', n FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM j WHERE reason IS NULL)) AS n FROM j WHERE reason IS NULL) WHERE n > 0""",
    ),
    "corpus_dedup_exact": (corpus_dedup_exact, "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"),
    "corpus_group_split": (corpus_group_split, "SELECT doc_id, sha256(text) AS schema_group, CASE WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 100 < 10 THEN 'validation' ELSE 'train' END AS split FROM documents"),
    "corpus_leakage_check": (corpus_leakage_check, "SELECT sha256(text) AS schema_group FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 10 = 0) > 1"),
    "corpus_family_holdout": (corpus_family_holdout, "SELECT source, CASE WHEN source IN ('src3', 'src7') THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1, 2"),
    "corpus_overlap": (
        corpus_overlap,
        """WITH b AS (SELECT DISTINCT trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\\s+', ' ', 'g')) AS k FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\\s+', ' ', 'g')) AS k FROM documents)
SELECT doc_id, count(*) AS hits FROM d WHERE k IN (SELECT k FROM b) GROUP BY doc_id""",
    ),
    "corpus_stratified_sample": (
        corpus_stratified_sample,
        """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS rk FROM documents),
s AS (SELECT lang, count(*) AS c, CASE lang WHEN 'es' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS o FROM documents GROUP BY lang),
q AS (SELECT *, least(c, 350 // (SELECT count(*) FROM s)) AS base FROM s),
l AS (SELECT *, 350 - sum(base) OVER () AS missing, coalesce(sum(c - base) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, r.lang FROM r JOIN l ON r.lang = l.lang WHERE rk <= base + greatest(0, least(c - base, missing - before))""",
    ),
    "corpus_hash_sample": (corpus_hash_sample, "SELECT doc_id, lang FROM documents ORDER BY sha256('train:' || doc_id) LIMIT 100"),
    "corpus_messages": (corpus_messages, "SELECT conv_id, count(*) AS turns, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS rendered FROM conversations GROUP BY conv_id"),
    "corpus_resume_pending": (corpus_resume_pending, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "corpus_join_labels": (corpus_join_labels, "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)"),
    "metrics_rates": (metrics_rates, "SELECT source, count(*) AS examples, sum(quality)::BIGINT AS quality_count, avg(quality) AS quality_rate, sum(toxic)::BIGINT AS toxic_count, avg(toxic) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY source"),
    "metrics_compare": (
        metrics_compare,
        """WITH r AS (SELECT lang, doc_id % 2 AS side, avg(quality) AS q FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT a.lang, round(a.q, 9) AS quality_rate_a, round(b.q, 9) AS quality_rate_b, round(b.q - a.q, 9) AS quality_rate_delta FROM r a JOIN r b ON a.lang = b.lang AND a.side = 0 AND b.side = 1""",
    ),
    "uniqueness_check": (uniqueness_check, "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "fk_orphans": (fk_orphans, "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "multiset_equal": (multiset_equal, "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS surplus FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1, 2"),
    "result_fingerprint": (result_fingerprint, "SELECT sha256(string_agg(n_nationkey || chr(9) || n_name || chr(9) || n_regionkey, chr(10) ORDER BY n_nationkey)) AS rows_hash FROM nation"),
    "corpus_fingerprint": (
        corpus_fingerprint,
        corpus_queries._tree_sql("documents", "text", "doc_id"),
    ),
    "tier_counts": (tier_counts, "SELECT CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 4000 THEN 'medium' ELSE 'heavy' END AS tier, count(*) AS n FROM documents GROUP BY 1"),
    "tier_curriculum": (
        tier_curriculum,
        """WITH t AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN 'small' WHEN n_chars < 4000 THEN 'medium' ELSE 'heavy' END AS tier FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY sha256(doc_id::VARCHAR)) AS rk FROM t)
SELECT doc_id, tier FROM r WHERE rk <= CASE tier WHEN 'small' THEN 120 WHEN 'medium' THEN 50 ELSE 30 END""",
    ),
    "template_expand": (
        template_expand,
        """WITH v AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS n FROM region), q AS (SELECT 1 AS p, 'Quantos clientes há na região ' AS a, '?' AS z UNION ALL SELECT 2, 'Conte os clientes da região ', '.')
SELECT printf('region-customers-%03d-p%d', n, p) AS id, 'region-customers' AS family, a || r_name || z AS question,
'SELECT count(*) AS clientes FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = ''' || r_name || '''' AS sql FROM v, q""",
    ),
    "sketch_execute": (sketch_execute, ANSWERS),
    "sketch_candidates": (sketch_candidates, f"SELECT nation, number, true AS executed, answer FROM ({ANSWERS})"),
    "sketch_render": (
        sketch_render,
        """WITH n AS (SELECT DISTINCT c_nationkey AS nation FROM customer), q AS (SELECT 0 AS number, 'SELECT COUNT("Name") FROM "nation_' AS a, '" WHERE "Segment" = ''BUILDING''' AS z UNION ALL SELECT 1, 'SELECT MAX("Balance") FROM "nation_', '" WHERE "Balance" < 5000' UNION ALL SELECT 2, 'SELECT MIN("Balance") FROM "nation_', '" WHERE "Segment" = ''MACHINERY'' AND "Balance" > 0'
UNION ALL SELECT 3, 'SELECT AVG("Balance") FROM "nation_', '" WHERE "Balance" > 100' UNION ALL SELECT 4, 'SELECT SUM("Balance") FROM "nation_', '" WHERE "Balance" < 0' UNION ALL SELECT 5, 'SELECT "Name" FROM "nation_', '" WHERE "Balance" > 9000')
SELECT nation, number, a || nation || z AS sql FROM n, q""",
    ),
}


def _gated(sql: str, dealt: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: governed(spark, sf_dir, sql, dealt=dealt)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _gated(sql, DEALT.get(name)) for name, sql in SHARED.items()}
    found |= {name: _gated(pair[0]) for name, pair in PAIRS.items()}
    return found | {name: f for name, (f, _) in (OPERATORS | more_queries.OPERATORS | corpus_queries.OPERATORS).items()}


def oracle_sql() -> dict[str, str]:
    found = dict(SHARED) | {name: pair[1] for name, pair in PAIRS.items()}
    return found | {name: sql for name, (_, sql) in (OPERATORS | more_queries.OPERATORS | corpus_queries.OPERATORS).items() if sql}
