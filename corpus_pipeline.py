"""A training-data pipeline over the documents table: five stages, each one of the operators.

1. quality: the line-level random field, fitted on the labelled documents; rejected ones go.
2. near_dedup: 5-word shingles, similarity 0.8; of each group of copies one row stays, that with the
   smallest id, null ids last. Rows that share an id but not a text are judged each for itself; of
   rows equal in id and text one stays.
3. decontaminate: rows whose text holds a 10-word window of a benchmark item go, and no others.
4. secrets: every secret value becomes [REDACTED]; all documents stay.
5. encode: SentencePiece ids of every text, and the text that they decode to.

All stages but the last return the columns of documents; n_chars follows a changed text. Null texts
are kept as they are by stages 2 to 4 and have no ids. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.common import materialize, table
from itemforge.llm.near_dup import near_groups
from itemforge.llm.near_dup import row_key as dup_key
from itemforge.llm.pieces import encode as piece_encode
from itemforge.llm.positional_index import decontaminate as find_leaks
from itemforge.llm.positional_index import row_key as leak_key
from itemforge.llm.quality import score, train
from itemforge.llm.secrets import find_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in docs.columns)), model, text="__text")
    return scored.where("predicted = 1").select(*(F.col(f"`__{c}`").alias(c) for c in docs.columns))


def _keyed(docs: DataFrame, *keys) -> DataFrame:
    """doc (the row as it is) and keys made of its id and text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *keys)


def _plain(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*(F.col("doc")[c].alias(c) for c in names))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = materialize(near_groups(docs.select("doc_id", "text"), k=5, percent=80).where("n_shingles > 0").select("doc_id", "row", "chosen"), "groups")
    is_chosen = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("row") == F.col("chosen.row"))
    dropped = groups.where(~is_chosen).select("row", F.lit(True).alias("goes")).distinct()
    repeated = groups.where(is_chosen).groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row", F.lit(False).alias("goes"))
    marks = materialize(dropped.union(repeated), "marks")
    known = _keyed(docs, dup_key().alias("row")).join(marks, "row", "left")
    rows = known.where("goes is null").select("doc")
    if not marks.where("not goes").isEmpty():
        first = F.row_number().over(Window.partitionBy("row").orderBy(F.to_json("doc")))
        rows = rows.union(known.where("not goes").withColumn("k", first).where("k = 1").select("doc"))
    return _plain(rows, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("h1", "h2").distinct()
    return _plain(_keyed(docs, *leak_key()).join(leaks, ["h1", "h2"], "left_anti"), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = docs.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in docs.columns))
    found = find_secrets(plain, text="__text", spans="secrets", redacted="redacted")
    new = {"text": F.col("redacted"), "n_chars": F.char_length("redacted").cast("long")}
    return found.select(*(F.when(F.size("secrets") > 0, new[c]).otherwise(F.col(f"`__{c}`")).alias(c) if c in new else F.col(f"`__{c}`").alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = piece_encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: Training and graph components are beyond SQL; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
