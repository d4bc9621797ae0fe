import pytest

from pyspark.sql import functions as F, types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LONG = "one two three four five six seven eight nine ten eleven twelve " * 600


def rows():
    return [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 5),  # repeated
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", None, "b", None),  # copy
        (3, None, "en", "b", 0),
        (4, "", "en", None, 0),
        (5, " \n\t ", "en", "c", 4),
        (6, LONG, "en", "a", len(LONG)),
        (None, "token = abcdef123 and more words to read here", "en", "b", 1),
        (None, None, None, None, None),
        (7, "short", "en", "\U0001f600", 5),
        (8, "x <|endoftext|> y  z", "en", "c", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies."""
    return spark.createDataFrame(rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns named as operators name theirs."""
    names = "key uid unit size taken score spans start length n_tokens part rank label bands draws _unit _uid cell".split()
    return odd.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
