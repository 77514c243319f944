"""Joins that enrich items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.functions.text import match_key


def last_wins(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """One row a key, with the value that comes last; a partial aggregate, so hot keys are cheap."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def match_answers(questions: DataFrame, solved: DataFrame) -> DataFrame:
    """Answers by (year, first 80 characters of the normalised text). The last file in name order
    wins; pairs without an answer don't take part; an item keeps its answer where nothing matches."""
    # The key is never null, so no filter is inferred that would make it twice. NUL is in no key.
    key = F.coalesce(match_key(F.col("question")), F.lit("\0"))
    pairs = solved.where((F.coalesce("answer", F.lit("")) != "") & F.col("question").isNotNull()).withColumn("key", key)
    found = last_wins(pairs, ["year", "key"], "answer", ["file", "pair_ord"]).withColumnRenamed("answer", "found")
    keyed = questions.withColumn("key", key)
    joined = keyed.join(found, ["year", "key"], "left")
    return joined.withColumn("answer", F.coalesce("found", "answer")).select(*questions.columns)


def upsert_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Overwrite answers by id from (ord, id, answer); unknown ids are ignored, the last one wins."""
    new = last_wins(answers, ["id"], "answer", ["ord"]).withColumnRenamed("answer", "new")
    return questions.join(new, "id", "left").withColumn("answer", F.coalesce("new", "answer")).select(*questions.columns)
