import pytest

LONG = "word " * 30_000
ROWS = [
    (1, "Hello there, world.\nSecond line of text.", "en", "a", 5),
    (2, None, None, "a", None),
    (3, "", "en", None, 0),
    (4, "  \n\t ", "fr", "a", 5),
    (5, "Hello there, world.\nSecond line of text.", "en", "b", 5),
    (5, "Hello there, world.\nSecond line of text.", "en", "b", 5),
    (6, LONG, "en", "b", len(LONG)),
    (7, "12345 67890", None, "b", 11),
    (8, "Ünïcödé 漢字 ▁mark  two   spaces <|endoftext|> </s> \x00 end ", "de", "b", 3),
    (None, "no id here", "en", "b", 10),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    names = "score ids decoded secrets redacted lang_pred shard slot start n_tokens words hits n key rep component kept".split()
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
