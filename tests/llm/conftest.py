import pytest
from pyspark.sql import functions as F

ODD = [
    (1, "a b c d e f g h", "x"),
    (1, "a b c d e f g h", "x"),  # a repeated row
    (1, "another text under one id", "x"),
    (2, None, "x"),
    (3, "", None),
    (None, "a b c d e f g h", "x"),
    (None, None, None),
    (4, " \n\t \r\n", "x"),
    (5, "Ünï © 😀 ▁ <|im_end|> \x00\x01 tail", "x"),
    (6, "w" * 50_000, "x"),
    (7, "line one\nline two\nline three\n" * 400, "x"),
    (8, "9" * 30_000 + " 1 2 3 " + "a" * 30_000 + "@", "x"),
    (9, "a b c d e f g h", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may come, and columns named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string")
    return df.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(7).alias("row"), F.lit("k").alias("id"), F.lit(1.5).alias("n_words"), F.lit(2).alias("kept"), F.lit("q").alias("sum"), F.lit(0).alias("ids"))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
