"""A corpus pipeline of five stages, each one operator of millrace.llm.

Every stage takes (spark, docs, sf_dir), where docs are the rows that the stage
before it kept, and returns what it keeps with the columns of documents; the last
returns the token records.

For all stages: an empty table gives an empty result; columns beside those of
documents pass through under their own names, whatever they are called; a row is
judged by its text, source and id alone, so repeated rows fare alike unless a stage
says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm._session import stored
from millrace.llm.decontam import decontaminate
from millrace.llm.jaccard import representatives
from millrace.llm.langid import accepted
from millrace.llm.mixing import mixture
from millrace.llm.tokens import materialise


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Texts go to the Python workers 8 MB at a time, unless the session says otherwise: a batch stands several times over outside the executor's heap, for every task."""
    if spark.conf.get(ARROW_BATCH) == f"{64 << 20}b":  # Spark's default
        spark.conf.set(ARROW_BATCH, most)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts without letters or without a clear language go.

    A null, empty or blank text goes; so does every text if no row has a lang to
    learn from.  Rows without an id, source or lang are judged like others; a very long
    text is read whole; equal proportions (ties) go to the language first by code point.
    """
    _small_batches(spark)
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets of Jaccard similarity 0.8 or more.

    The smallest id of a component stays; of repeated rows of one id one stays; a row
    without an id goes if its component has an id, else it stays.  Texts without words
    (null, empty, blank) are alike to nothing and all stay; a very long text is one set.
    """
    _small_batches(spark)
    return representatives(docs, k=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as everything does if the benchmark is
    empty; rows without an id are searched like others; a very long text is searched whole.
    """
    _small_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: documents left out, taken once, or taken twice.

    A null source is a source of its own, the last; a null or empty text has size 0; rows
    of one id (or, without an id, of one text) are taken alike, as ties of their hash.
    """
    return mixture(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed-size token records in training order.

    A null text is an end token alone; repeated rows are kept each; rows without an id
    have their place by text; a text of any length is tokenised whole.
    """
    _small_batches(spark)
    return materialise(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mix_sources", mix_sources), ("token_records", token_records)]

#: Language mixtures, tokenising and the permutation have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
