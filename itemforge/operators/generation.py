"""Requests for missing answers: batches, prompts and replies. The model itself is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.functions.text import strip
from itemforge.sources.bank import numbered

BATCH = 8
REPLY = "array<struct<id:string,answer:string>>"


def batches(df: DataFrame, order: str, size: int = BATCH, group: str | None = None) -> DataFrame:
    """Number rows into batches of size in stored order, within each group or over all rows.

    Over all rows, order has to be a gapless position from 0 (sources.bank.numbered makes one).
    Within groups, all rows are numbered by group and order, and a group's first number is taken
    off, so that no task holds a large group."""
    if group is None:
        return df.withColumn("batch", F.floor(F.col(order) / size).cast("long"))
    rows = numbered(df, F.col(group), F.col(order), name="batch")
    first = rows.groupBy(F.col(group).alias("own_group")).agg(F.min("batch").alias("first_of_group"))
    both = rows.join(first, F.col(group).eqNullSafe(F.col("own_group")))
    return both.withColumn("batch", F.floor((F.col("batch") - F.col("first_of_group")) / size).cast("long")).drop("own_group", "first_of_group")


def prompts(batched: DataFrame, instructions: str, order: str = "ord") -> DataFrame:
    """(batch, prompt): the instructions, then id, chapter and question of each item of a batch."""
    item = F.concat_ws("\n", F.concat(F.lit("ID: "), "id"), F.concat(F.lit("Chapter: "), "chapter"), F.concat(F.lit("Q: "), "question"), F.lit(""))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("t")))), lambda x: x["t"])
    return batched.groupBy("batch").agg(F.concat(F.lit(instructions + "\n\n"), F.array_join(listed, "\n")).alias("prompt"))


def reply(text: Column) -> Column:
    """The JSON array of a reply, without code fences; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(strip(bare), REPLY)


def reply_answers(replies: DataFrame) -> DataFrame:
    """(ord, id, answer) of replies (batch, text), later batches after earlier ones."""
    rows = replies.select("batch", F.posexplode(reply(F.col("text"))).alias("k", "r"))
    return rows.select((F.col("batch") * 1_000_000 + F.col("k")).alias("ord"), "r.id", "r.answer")
