"""Per-user bookmarks, solved sets and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.functions.labels import percent, progress_band


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """What an odd number of toggles leaves on."""
    return events.groupBy(*keys).agg(F.count("*").alias("n")).where("n % 2 = 1").select(*keys)


def members(df: DataFrame, ids: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Rows whose id is in the set, in stored order; stale ids match nothing."""
    return df.join(ids.select(key).distinct(), key, "left_semi").orderBy(order)


def chapter_progress(chapters: DataFrame, questions: DataFrame, solved: DataFrame) -> DataFrame:
    """(name, solved, total, pct, band); a chapter without questions stays with zeros."""
    done = solved.select("id").distinct().withColumn("done", F.lit(True))
    counts = questions.join(done, "id", "left").groupBy(F.col("chapter").alias("name")).agg(F.count("*").alias("total"), F.count_if(F.coalesce("done", F.lit(False))).alias("solved"))
    out = chapters.select("name").join(counts, "name", "left").na.fill(0, ["total", "solved"])
    out = out.withColumn("pct", percent(F.col("solved"), F.col("total")))
    return out.select("name", "solved", "total", "pct", progress_band(F.col("pct")).alias("band"))


def overall_progress(questions: DataFrame, solved: DataFrame) -> DataFrame:
    """The size of the set against all questions; stale ids count, so it may pass 100."""
    rows = solved.select("id").distinct().select(F.lit(True).alias("done")).union(questions.select(F.lit(False).alias("done")))
    counts = rows.agg(F.count_if("done").alias("solved"), F.count_if(~F.col("done")).alias("total"))
    return counts.withColumn("pct", percent(F.col("solved"), F.col("total")))
