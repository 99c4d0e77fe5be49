import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a DataFrame dealt over a few partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (None, "the cat sat on the mat and then it left the old house by the sea", "en", None),
    (4, "   \n\t ", "en", "a"),
    (5, "12345 !!! ???", None, "b"),
    (6, "the cat sat on the mat and then it left the old house by the sea", "en", "b"),
    (6, "the cat sat on the mat and then it left the old house by the sea", "en", "b"),
    (7, "word " * 30_000, "en", "b"),
    (8, "é", "fr", ""),
]


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and extra columns of clashing names."""
    rows = [(*r, 1, "x", 2.5, "y") for r in ODD]
    return frame(rows, "doc_id long, text string, lang string, source string, n int, key string, score double, mix_size string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
