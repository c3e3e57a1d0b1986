import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

ODD = [
    (1, "One two three four five six.\nSecond line here.\nThird line here.\nFourth.", "en", "a", 5),
    (2, "One two three four five six.\nSecond line here.\nThird line here.\nOther end.", "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 3),
    (6, "12345 !!! ???", "de", "b", 13),
    (7, "One two three four five six.\nSecond line here.\nThird line here.\nFourth.", "en", "a", 5),
    (None, "A row without an id, but with words.", "en", None, 1),
    (8, "ünïcode 日本語 🙂 " * 3000, "fr", "c", 9),
    (9, "word", "en", "c", 4),
    (9, "word", "en", "c", 4),
]


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).withColumn("_text", F.lit("clash")).withColumn("score", F.lit(1))
    return df.withColumn("_key", F.col("doc_id"))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names the operators use as well."""
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
