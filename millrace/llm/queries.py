"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) where the document holds the item within the edit threshold."""
    from .decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearvec import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS seen FROM v UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*)::BIGINT AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.id LEFT JOIN n ON e.vec_id = n.a
"""


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in slot order within its shard, with the digest of its ids."""
    from .tokens import digests, materialise

    return digests(materialise(_table(spark, sf_dir, "documents")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT a AS id, b AS seen FROM p UNION SELECT r.id, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT id, min(seen) AS least FROM r GROUP BY id)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, least(g.doc_id, coalesce(c.least, g.doc_id)) AS component_id FROM g LEFT JOIN c ON g.doc_id = c.id
"""


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent import score

    return score(_table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


OP7_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id < r.last_doc AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE / w AS fill FROM w),
r AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
                 - coalesce(sum(source_size) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE)
                / sum(w) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM f),
t AS (SELECT source, source_size,
             least(source_size * 2.0::DOUBLE, coalesce(max(CASE WHEN rate < fill THEN rate END) OVER () * w, source_size * 2.0::DOUBLE)) AS target FROM r),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS whole FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, g.size, n.target - n.whole * n.source_size AS need,
             sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h)::BIGINT AS run
      FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source),
e AS (SELECT source, min_by(CASE WHEN size < 2 * (need - (run - size)) THEN h + 1 ELSE h END, h) AS below FROM c WHERE run > need GROUP BY source)
SELECT d.doc_id, d.size::BIGINT AS size, n.source_size, n.target,
       (d.size * (n.whole + CASE WHEN d.h < e.below THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import rate

    return rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


SHARD_LIMIT = 16 << 20


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_LIMIT)
    return out.select("doc_id", F.col("shard_bytes_own").alias("bytes"), F.col("shard_depth").cast("int").alias("depth"), F.col("shard_prefix").alias("prefix"), "shard_bytes", "shard_docs", "oversize")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
k AS (SELECT range::INTEGER AS depth FROM range(0, 61)),
n AS (SELECT k.depth, d.h >> (60 - k.depth) AS prefix, sum(d.bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_docs
      FROM d, k GROUP BY 1, 2),
a AS (SELECT d.h, min(k.depth) AS depth FROM d, k JOIN n ON n.depth = k.depth
      WHERE n.prefix = d.h >> (60 - k.depth) AND (n.shard_bytes <= {SHARD_LIMIT} OR k.depth = 60) GROUP BY d.h)
SELECT d.doc_id, d.bytes, a.depth, n.prefix, n.shard_bytes, n.shard_docs, n.shard_bytes > {SHARD_LIMIT} AS oversize
FROM d JOIN a USING (h) JOIN n ON n.depth = a.depth AND n.prefix = d.h >> (60 - a.depth)
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte, its table made by rule; near words by equal deletions at one place, or a deletion that is the other word.
OP11_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
x AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(t, '[a-z\\x{00C0}-\\x{00FF}]+')) AS run FROM d),
c AS (SELECT doc, run, count(*) AS n FROM x GROUP BY doc, run),
tab AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, 3988292384 * (v & 1))) AS v FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT c.*, list_transform(string_split(doc || ':' || run, ''), lambda y: unicode(y)) AS cp FROM c),
b AS (SELECT doc, run, n, flatten(list_transform(cp, lambda y: CASE WHEN y < 128 THEN [y] ELSE [195, y - 64] END)) AS bytes FROM h),
z AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda v, y: xor(v >> 8, tab.tab[(xor(v, y) & 255) + 1])), 4294967295::BIGINT) AS crc FROM b, tab),
y AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, (crc % length(run))::INTEGER) || substr(run, (crc % length(run))::INTEGER + 2) ELSE run END AS word, n FROM z),
w AS (SELECT word, sum(n)::BIGINT AS n FROM y WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
e AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
o AS (SELECT a.word AS x, b.word AS y, b.n FROM e a JOIN e b ON a.short = b.short AND a.p = b.p AND a.word <> b.word
      UNION SELECT e.word, w.word, w.n FROM e JOIN w ON e.short = w.word UNION SELECT w.word, e.word, e.n FROM e JOIN w ON e.short = w.word),
m AS (SELECT x, count(*)::BIGINT AS n_near, max(n) AS most FROM o GROUP BY x),
f AS (SELECT w.word, w.n, coalesce(m.n_near, 0)::BIGINT AS n_near, CASE WHEN m.most >= 5 * w.n THEN m.most END AS form_n,
             CASE WHEN m.most >= 5 * w.n THEN (SELECT min(o.y) FROM o WHERE o.x = w.word AND o.n = m.most) END AS form FROM w LEFT JOIN m ON w.word = m.x),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, max_by(root, step) AS root FROM r GROUP BY word) l ON f.word = l.word
"""


def op12_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cleaning import ADDED, judged

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, with_text=False).select("doc_id", *[c for c in ADDED if c != "clean_text"])


def _op12_sql() -> str:
    from . import cleaning as c

    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ends, closers = c.ENDS.replace(".", "\\."), c.CLOSERS.replace("'", "''").replace("]", "\\]")
    phrases = "|".join(c.BOILERPLATE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT row, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
u AS (SELECT row, i, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM g),
v AS (SELECT row, count(DISTINCT p)::BIGINT AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM u WHERE n > 1) GROUP BY row),
x AS (SELECT row, unnest(l) AS line FROM w),
y AS (SELECT row, line, trim(line, {white}) AS s, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
             len(regexp_extract_all(line, '[{c.SYMBOLS}]')) AS symbols, len(regexp_extract_all(line, '[{c.SEPARATORS}]')) AS separators,
             regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{phrases}') AS phrase FROM x),
z AS (SELECT row, line, n, 4 * symbols > n OR separators >= 2 AND 3 * separators >= n OR phrase
             OR NOT regexp_matches(s, '[{ends}][{closers}]*$') AND NOT (n >= {c.LONG_LINE} AND regexp_matches(s, '[.!?…][\\x20\\x09]')) AS bad FROM y),
q AS (SELECT row, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS failed, coalesce(sum(n) FILTER (bad), 0) AS lost FROM z GROUP BY row),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[{c.SYMBOLS}]'))::BIGINT AS n_symbols,
             coalesce(q.dup, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, coalesce(q.failed, 0)::BIGINT AS n_failed_lines, coalesce(q.lost, 0)::BIGINT AS n_lost_words
      FROM w LEFT JOIN v USING (row) LEFT JOIN q USING (row)),
b AS (SELECT *, n_words < {c.MIN_WORDS} OR 100 * n_repeat_words > {c.MAX_REPEAT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * n_lost_words <= {c.MAX_LOST} * n_words AS kept FROM b
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocation import collocations

    return collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
o AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w),
f AS (SELECT lang, k, phrase, lang || chr(9) || phrase AS key, count(*)::BIGINT AS a FROM o GROUP BY lang, k, phrase HAVING count(*) >= 10 OR k = 1),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, phrase, a, 1 AS cut, lang || chr(9) || w[1] AS p, lang || chr(9) || array_to_string(w[2:], ' ') AS s FROM c
      UNION ALL SELECT lang, phrase, a, 2, lang || chr(9) || array_to_string(w[1:2], ' '), lang || chr(9) || w[3] FROM c WHERE k = 3),
s AS (SELECT x.lang, x.phrase, x.a, cut, l.a AS l, r.a AS r, ((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
      FROM x JOIN f l ON l.key = x.p JOIN f r ON r.key = x.s),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM s),
y AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3) GROUP BY lang, part),
t AS (SELECT m.* FROM m LEFT JOIN y ON y.lang = m.lang AND y.part = m.phrase WHERE place = 1 AND (y.longer IS NULL OR 100 * y.longer < 50 * m.a)),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM t)
SELECT q.lang, rank, phrase, a, l, r, n.n, score FROM q JOIN n USING (lang) WHERE rank <= 2000
"""


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_near_vectors": op2_near_vectors,
        "op3_tokens": op3_tokens,
        "op4_language": op4_language,
        "op5_jaccard": op5_jaccard,
        "op6_lm_score": op6_lm_score,
        "op7_lines": op7_lines,
        "op8_mix": op8_mix,
        "op9_shard": op9_shard,
        "op10_toxicity": op10_toxicity,
        "op11_spelling": op11_spelling,
        "op12_clean": op12_clean,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_vectors": OP2_SQL, "op5_jaccard": OP5_SQL, "op7_lines": OP7_SQL, "op8_mix": OP8_SQL, "op9_shard": OP9_SQL, "op11_spelling": OP11_SQL, "op12_clean": _op12_sql(), "op13_collocations": OP13_SQL}
