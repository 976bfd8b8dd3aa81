import pytest

#: What every operator must get through: nulls, empty and long texts, ties, repeated rows, clashing extra columns.
EDGE = [
    (1, "Hello World again and again", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "hello world again and again", "en", "b", 5),
    (4, "hello world again and again", "en", "b", 5),
    (5, " \n\t \n", "fr", None, 1),
    (6, "wordé " * 40_000, "fr", "b", 9),
    (7, "one two", None, "a", 2),
    (None, "no number at all", "en", "c", 3),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGE, COLUMNS)
    clash = ["size", "taken", "n_words", "ords", "flags", "name", "kept", "score", "range", "component"]
    return docs.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def sample():
    """Documents of the smallest tables, whole."""
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
