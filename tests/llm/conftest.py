import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
    # names that operators could want for themselves
    StructField("__id", StringType()), StructField("__mark", StringType()), StructField("size", StringType()), StructField("Digest", StringType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text, source) rows, with extra columns of clashing names."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "d") for i, t, s in rows], DOCUMENTS)

    return make


ODD = [
    (1, None, "a"), (2, "", None), (3, "one", "a"), (3, "one", "a"), (4, "one", "b"), (None, "one", "b"), (None, None, None),
    (5, "x " * 40_000, "a"), (6, "  one\t\n", "a"), (7, "ünïcödé 日本語 🤗 <|endoftext|> Σας", "c"), (8, "a b c d e f", "c"), (9, "you stupid idiot. he said you idiot", "c"),
]


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empty and long texts, ties, repeated rows."""
    return documents(ODD)


@pytest.fixture(scope="session")
def none(documents):
    return documents([])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (9, 0, 1), (None, 1, 0), (8, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
