import pytest

from tests.conftest import SMALL

ODD = [
    (1, "Ab cd ef gh ij", "en", "s1"),
    (1, "Ab cd ef gh ij", "en", "s1"),
    (2, None, None, None),
    (3, "", "en", "s2"),
    (4, " \n\t ", "de", "s2"),
    (None, "null id and words", None, "s1"),
    (5, "word " * 40_000 + "end", "en", "s3"),
    (6, "日本 語 été 1234 !!", "fr", None),
    (7, "x", "en", "\U0001f600"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    names = ("id", "u", "v", "node", "root", "row", "size", "n", "key", "h", "line", "fp", "length", "piece", "_p", "words", "low", "target", "taken", "chunk", "ratio", "first", "_lines", "_id", "_gone")
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(k) for k, n in enumerate(names)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
