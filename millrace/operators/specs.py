"""Question-to-SQL specifications from parameter grids and paraphrases.

A family is data: a grid of parameters, paraphrased question templates and one
SQL template.  Expansion is the product of grid rows and paraphrases, done as a
join of two small tables, and checked before use.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import question_key
from . import corpus


@dataclass(frozen=True)
class Family:
    name: str
    grid: Mapping[str, Sequence[object]]
    questions: tuple[str, ...]
    sql: str
    tier: str = "small"
    pack: str = ""


def expand(spark: SparkSession, families: Sequence[Family]) -> DataFrame:
    """(id, family, tier, pack, question, sql): every row of every grid with every paraphrase."""
    values, asked = [], []
    for f in families:
        for i, row in enumerate(product(*f.grid.values()), 1):
            values.append((f.name, i, dict(zip(f.grid, map(str, row), strict=True)), f.sql, f.tier, f.pack))
        asked += [(f.name, i, q) for i, q in enumerate(f.questions, 1)]
    grid = spark.createDataFrame(values, "family string, row_number int, params map<string,string>, template string, tier string, pack string")
    texts = spark.createDataFrame(asked, "family string, template_number int, asked string")
    both = corpus.expand(grid, texts)

    def filled(template: F.Column) -> F.Column:
        return F.aggregate(F.map_entries("params"), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))

    return both.select("id", "family", "tier", "pack", filled(F.col("asked")).alias("question"), filled(F.col("template")).alias("sql"))


def defects(specs: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """(defect, value, occurrences): repeated ids and question keys, and questions that stand in a frozen benchmark; empty if sound."""
    out = None
    for name, key in (("repeated_id", F.col("id")), ("repeated_question", question_key(F.col("question")))):
        part = corpus.repeated(specs, key.alias("value")).select(F.lit(name).alias("defect"), "value", "occurrences")
        out = part if out is None else out.unionByName(part)
    if frozen is not None:
        met = corpus.overlapping(specs, question_key(F.col("question")), frozen, question_key(F.col("question")))
        out = out.unionByName(met.groupBy(F.col("id").alias("value")).agg(F.count(F.lit(1)).alias("occurrences")).select(F.lit("frozen_question").alias("defect"), "value", "occurrences"))
    return out


def executed(specs: DataFrame, runner) -> DataFrame:
    """Run SQL once for each canonical form and join the outcome back: (.., executed, row_count, error)."""
    from ..plans.analyze import canonical, with_analysis

    def one(sql: str) -> tuple:
        found = runner(sql)
        return found.executed, len(found.rows), found.error

    return with_analysis(specs, "sql", one, "executed boolean, row_count int, error string", lambda sql: canonical(specs.sparkSession, sql))


#: Families over the test tables, one for each shape of query.
FAMILIES = (
    Family("count-filter", {"status": ("F", "O", "P"), "least": (100000, 200000)}, ("Quantos pedidos com situação {status} passam de {least}?", "Conte os pedidos {status} acima de {least}."), "SELECT count(*) AS total FROM orders WHERE o_orderstatus = '{status}' AND o_totalprice > {least}"),
    Family("list-ordered", {"brand": ("Brand#11", "Brand#22")}, ("Liste as peças da marca {brand} pela mais cara.",), "SELECT p_name, p_retailprice FROM part WHERE p_brand = '{brand}' ORDER BY p_retailprice DESC, p_name"),
    Family("prefix", {"letter": tuple("ABCDE")}, ("Quais peças começam com a letra {letter}?",), "SELECT p_name FROM part WHERE p_name ILIKE '{letter}%' ORDER BY p_name"),
    Family("distinct-join", {"segment": ("BUILDING", "MACHINERY")}, ("Quais nações têm clientes do segmento {segment}?",), "SELECT DISTINCT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = '{segment}' ORDER BY n_name", "medium"),
    Family("left-join-count", {"most": (5000, 20000)}, ("Quantos pedidos de até {most} há por cliente?",), "SELECT c_name, count(o_orderkey) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice <= {most} GROUP BY c_name ORDER BY total DESC, c_name", "medium"),
    Family("range-sum", {"low": (1, 10), "high": (20, 40)}, ("Qual a receita das linhas com quantidade entre {low} e {high}?",), "SELECT round(sum(l_extendedprice), 2) AS receita FROM lineitem WHERE l_quantity BETWEEN {low} AND {high}"),
    Family("top-k", {"k": (3, 5, 10)}, ("Quais os {k} clientes que mais compraram?",), "SELECT c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY total DESC, c_name LIMIT {k}", "medium"),
    Family("by-day", {"day": (1, 15)}, ("Quantos pedidos houve no dia {day} de cada mês?",), "SELECT date(o_orderdate) AS dia, count(*) AS total FROM orders WHERE extract(DAY FROM o_orderdate) = {day} GROUP BY date(o_orderdate) ORDER BY dia"),
    Family("preaggregated", {"priority": ("1-URGENT", "5-LOW")}, ("Qual o total por segmento dos pedidos de prioridade {priority}?",), "WITH linhas AS (SELECT l_orderkey, sum(l_extendedprice) AS valor FROM lineitem GROUP BY l_orderkey) SELECT c_mktsegment, round(sum(valor), 2) AS total FROM linhas JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '{priority}' GROUP BY c_mktsegment ORDER BY c_mktsegment", "heavy"),
    Family("count-all", {"table": ("orders", "customer", "part", "supplier", "lineitem", "nation", "region", "events")}, ("Quantas linhas tem a tabela {table}?", "Conte as linhas de {table}.", "Qual o número de linhas em {table}?"), "SELECT count(*) AS total FROM {table}"),
    Family("mean-by-segment", {"segment": ("BUILDING", "MACHINERY", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE")}, ("Qual o saldo médio dos clientes do segmento {segment}?", "Saldo médio em {segment}?"), "SELECT round(avg(c_acctbal), 2) AS media FROM customer WHERE c_mktsegment = '{segment}'"),
    Family("customers-of-nation", {"key": tuple(range(25)), "k": (3, 5, 10)}, ("Quais os {k} clientes de maior saldo da nação {key}?", "Mostre os {k} maiores saldos de clientes da nação {key}."), "SELECT c_name, c_acctbal FROM customer WHERE c_nationkey = {key} ORDER BY c_acctbal DESC, c_name LIMIT {k}"),
    Family("orders-by-month", {"year": (1993, 1994, 1995, 1996, 1997), "status": ("F", "O", "P")}, ("Quantos pedidos {status} houve por mês em {year}?", "Pedidos {status} de {year}, por mês?"), "SELECT extract(MONTH FROM o_orderdate) AS mes, count(*) AS total FROM orders WHERE extract(YEAR FROM o_orderdate) = {year} AND o_orderstatus = '{status}' GROUP BY extract(MONTH FROM o_orderdate) ORDER BY mes"),
    Family("brand-prices", {"brand": tuple(f"Brand#{i}" for i in range(1, 26)), "f": ("min", "max", "avg")}, ("Qual o preço ({f}) das peças da marca {brand}?",), "SELECT {f}(p_retailprice) AS preco FROM part WHERE p_brand = '{brand}'"),
    Family("size-range", {"low": (1, 5, 10, 20), "high": (25, 30, 40, 50)}, ("Quantas peças têm tamanho de {low} a {high}?", "Conte as peças de tamanho entre {low} e {high}."), "SELECT count(*) AS total FROM part WHERE p_size BETWEEN {low} AND {high}"),
    Family("region-revenue", {"region": tuple(range(5)), "flag": ("A", "N", "R")}, ("Qual a receita da região {region} nas linhas com marca {flag}?", "Receita da região {region}, linhas {flag}?"), "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS receita FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = {region} AND l_returnflag = '{flag}'", "heavy"),
    Family("suppliers-above", {"key": tuple(range(25)), "least": (0, 1000, 5000)}, ("Quantos fornecedores da nação {key} têm saldo acima de {least}?",), "SELECT count(*) AS total FROM supplier WHERE s_nationkey = {key} AND s_acctbal > {least}"),
    Family("never-ordered", {"key": tuple(range(25))}, ("Quais clientes da nação {key} nunca fizeram pedidos?", "Clientes da nação {key} sem pedidos?"), "SELECT c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = {key} AND o_orderkey IS NULL ORDER BY c_name", "medium"),
    Family("priority-share", {"priority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "status": ("F", "O", "P")}, ("Quantos pedidos {status} têm prioridade {priority}?", "Conte os pedidos {priority} com situação {status}."), "SELECT count(*) AS total FROM orders WHERE o_orderpriority = '{priority}' AND o_orderstatus = '{status}'"),
    Family("discounted-lines", {"least": (1, 2, 3, 4, 5, 6, 7, 8), "flag": ("A", "N", "R")}, ("Quantas linhas {flag} têm desconto acima de {least}%?", "Linhas {flag} com mais de {least}% de desconto?"), "SELECT count(*) AS total FROM lineitem WHERE l_discount > {least} / 100.0 AND l_returnflag = '{flag}'"),
    Family("event-totals", {"kind": ("click", "error", "view", "purchase"), "user": tuple(range(20))}, ("Quantos eventos {kind} teve o usuário {user}?",), "SELECT count(*) AS total FROM events WHERE event_type = '{kind}' AND user_id = {user}"),
    Family("status-share", {"status": ("F", "O", "P")}, ("Qual a porcentagem de pedidos com situação {status}?",), "SELECT round(100.0 * count(CASE WHEN o_orderstatus = '{status}' THEN 1 END) / count(*), 2) AS percentual FROM orders"),
    Family("having-orders", {"least": (5, 10)}, ("Quais clientes têm ao menos {least} pedidos?", "Clientes com {least} pedidos ou mais?"), "SELECT c_name, count(*) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) >= {least} ORDER BY total DESC, c_name", "medium"),
    Family("distinct-suppliers", {"size": (10, 20)}, ("Quantos fornecedores distintos entregaram peças de tamanho {size}?",), "SELECT count(DISTINCT l_suppkey) AS fornecedores FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = {size}", "medium"),
    Family("exists-order", {"least": (200000, 300000)}, ("Quantos clientes têm algum pedido acima de {least}?",), "SELECT count(*) AS clientes FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > {least})", "medium"),
    Family("above-average", {}, ("Quantos clientes têm saldo acima da média?",), "SELECT count(*) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)"),
    Family("year-total", {"year": (1993, 1994, 1995)}, ("Qual o valor total dos pedidos de {year}?",), "SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE extract(YEAR FROM o_orderdate) = {year}"),
    Family("quarter-orders", {"year": (1994, 1996)}, ("Quantos pedidos houve por trimestre em {year}?",), "SELECT extract(QUARTER FROM o_orderdate) AS trimestre, count(*) AS total FROM orders WHERE extract(YEAR FROM o_orderdate) = {year} GROUP BY extract(QUARTER FROM o_orderdate) ORDER BY trimestre"),
    Family("price-bands", {"most": (1000, 1500)}, ("Quantas peças custam menos de {most} e quantas custam mais?",), "SELECT CASE WHEN p_retailprice < {most} THEN 'baixo' ELSE 'alto' END AS faixa, count(*) AS total FROM part GROUP BY CASE WHEN p_retailprice < {most} THEN 'baixo' ELSE 'alto' END ORDER BY faixa"),
    Family("place-in-nation", {"k": (1, 2)}, ("Qual o cliente no lugar {k} em saldo de cada nação?",), "SELECT n_name, c_name FROM (SELECT n_name, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS lugar FROM customer JOIN nation ON n_nationkey = c_nationkey) t WHERE lugar = {k} ORDER BY n_name, c_name", "heavy"),
    Family("names-of-region", {"region": (0, 1)}, ("Liste os nomes da região {region} e de suas nações.",), "SELECT n_name AS nome FROM nation WHERE n_regionkey = {region} UNION SELECT r_name FROM region WHERE r_regionkey = {region} ORDER BY nome"),
    Family("never-flagged", {"flag": ("A", "R")}, ("Quantos pedidos não têm linha com marca {flag}?",), "SELECT count(*) AS total FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = '{flag}')", "medium"),
    Family("nation-list", {"list": ("1, 2, 3", "4, 5")}, ("Liste os clientes das nações {list}.",), "SELECT c_name FROM customer WHERE c_nationkey IN ({list}) ORDER BY c_name"),
    Family("one-year-from", {"day": ("1994-01-01", "1995-07-01")}, ("Quantos pedidos houve no ano que começa em {day}?",), "SELECT count(*) AS total FROM orders WHERE o_orderdate >= DATE '{day}' AND o_orderdate < DATE '{day}' + INTERVAL 1 YEAR"),
    Family("price-extremes", {"flag": ("A", "N", "R")}, ("Qual o menor e o maior preço das linhas {flag}?",), "SELECT min(l_extendedprice) AS menor, max(l_extendedprice) AS maior FROM lineitem WHERE l_returnflag = '{flag}'"),
    Family("longest-names", {"k": (3, 5)}, ("Quais as {k} peças de nome mais longo?",), "SELECT p_name, length(p_name) AS tamanho FROM part ORDER BY tamanho DESC, p_name LIMIT {k}"),
    Family("initials", {"letter": ("A", "M", "U")}, ("Quantas nações começam com {letter}?",), "SELECT count(*) AS total FROM nation WHERE upper(substring(n_name, 1, 1)) = '{letter}'"),
    Family("orders-without-lines", {}, ("Quantos pedidos não têm linhas?",), "SELECT count(*) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL", "medium"),
    Family("neighbours", {"region": (1, 2)}, ("Quantos pares de nações há na região {region}?",), "SELECT count(*) AS pares FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_regionkey = {region}"),
    Family("mean-lines", {}, ("Quantas linhas tem um pedido em média?",), "SELECT round(avg(itens), 2) AS media FROM (SELECT l_orderkey, count(*) AS itens FROM lineitem GROUP BY l_orderkey) t"),
    Family("largest-orders", {"k": (1, 3)}, ("Quais os {k} pedidos de maior quantidade?",), "SELECT o_orderkey, sum(l_quantity) AS quantidade FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY quantidade DESC, o_orderkey LIMIT {k}", "medium"),
    Family("segment-nation", {"segment": ("BUILDING", "MACHINERY")}, ("Qual nação tem mais clientes do segmento {segment}?",), "SELECT n_name, count(*) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = '{segment}' GROUP BY n_name ORDER BY total DESC, n_name LIMIT 1", "medium"),
    Family("known-balance", {"most": (0, 500)}, ("Quantos clientes têm saldo conhecido abaixo de {most}?",), "SELECT count(*) AS total FROM customer WHERE c_acctbal IS NOT NULL AND c_acctbal < {most}"),
    Family("brands-of-size", {"size": (1, 50)}, ("Quantas peças de tamanho {size} há por marca?",), "SELECT p_brand, count(*) AS total FROM part WHERE p_size = {size} GROUP BY p_brand ORDER BY total DESC, p_brand"),
    Family("suppliers-of-region", {"region": (0, 3)}, ("Quantos fornecedores tem cada nação da região {region}?",), "SELECT n_name, count(s_suppkey) AS total FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = {region} GROUP BY n_name ORDER BY n_name", "medium"),
    Family("running-total", {"key": (1, 2, 4)}, ("Qual o valor acumulado dos pedidos do cliente {key}?",), "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS acumulado FROM orders WHERE o_custkey = {key} ORDER BY o_orderkey"),
    Family("discount-value", {"flag": ("A", "N", "R")}, ("Quanto se deu de desconto nas linhas {flag}?",), "SELECT round(sum(l_extendedprice * l_discount), 2) AS desconto FROM lineitem WHERE l_returnflag = '{flag}'"),
    Family("mean-tax", {}, ("Qual o imposto médio das linhas?",), "SELECT round(avg(l_tax), 4) AS imposto FROM lineitem"),
    Family("orders-of-month", {"month": (6, 12)}, ("Quantos pedidos houve no mês {month}, em todos os anos?",), "SELECT count(*) AS total FROM orders WHERE extract(MONTH FROM o_orderdate) = {month}"),
    Family("event-users", {"kind": ("click", "purchase")}, ("Quantos usuários distintos tiveram eventos {kind}?",), "SELECT count(DISTINCT user_id) AS usuarios FROM events WHERE event_type = '{kind}'"),
    Family("count-and-sum", {"segment": ("BUILDING", "FURNITURE")}, ("Quantos clientes tem o segmento {segment} e qual seu saldo total?",), "SELECT count(*) AS clientes, round(sum(c_acctbal), 2) AS saldo FROM customer WHERE c_mktsegment = '{segment}'"),
)
