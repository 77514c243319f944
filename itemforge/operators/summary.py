"""Per-group summaries, facets and the statistics card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from itemforge.functions.labels import CHAPTERS, year_range
from itemforge.functions.text import slug


def group_summary(df: DataFrame, group: str, year: str, marks: str, order: str, drop_zero: bool = False) -> DataFrame:
    """(name, count, years ascending, marks_dist, first) of each group.

    Two aggregations: counts by (group, marks, year) shrink the data before lists are built."""
    fine = df.groupBy(F.col(group).alias("name"), F.col(marks).cast("string").alias("m"), F.col(year).alias("y")).agg(
        F.count("*").alias("n"), F.min(order).alias("first")
    )
    years = F.sort_array(F.collect_set(F.when(F.col("y") != 0, F.col("y")) if drop_zero else F.col("y")))
    by_group = fine.groupBy("name").agg(F.sum("n").alias("count"), years.alias("years"), F.min("first").alias("first"))
    dist = fine.where("m is not null").groupBy("name", "m").agg(F.sum("n").alias("n")).groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", "n")))).alias("marks_dist"))
    return by_group.join(dist, "name", "left").select("name", "count", "years", "marks_dist", "first")


def chapter_summary(questions: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Chapters in canonical order, unlisted ones after them as first seen."""
    spark = questions.sparkSession
    order = spark.createDataFrame([(k, n) for k, (_, n, _) in enumerate(CHAPTERS)], "place int, name string")
    found = group_summary(questions, "chapter", "year", "marks", "ord", drop_zero).join(order, "name", "left")
    return found.withColumn("slug", slug(F.col("name"))).orderBy(F.asc_nulls_last("place"), "first").select("name", "count", "years", "marks_dist", "slug", "place", "first")


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct truthy values, largest first."""
    return df.where(F.col(column) != 0).select(column).distinct().orderBy(F.desc(column))


def stats(questions: DataFrame) -> DataFrame:
    real = F.when(F.col("year") != 0, F.col("year"))
    return questions.agg(
        F.count("*").alias("total"), F.countDistinct("chapter").alias("chapters"),
        F.count_if(F.coalesce("answer", F.lit("")) != "").alias("matched_answers"), year_range(F.min(real), F.max(real)).alias("years"),
    )


def total_count(chapters: DataFrame) -> DataFrame:
    return chapters.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def chapter_years(chapters: DataFrame) -> DataFrame:
    return chapters.select("name", year_range(F.array_min("years"), F.array_max("years")).alias("years"))


def changed_rows(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """How many rows have a pair of columns, before and after, that differs."""
    differs = F.lit(False)
    for before, after in pairs:
        differs = differs | ~F.col(after).eqNullSafe(F.col(before))
    return rows.agg(F.count_if(differs).alias("modified"))


def written_with_figures(df: DataFrame, path: str, *figures: Column) -> dict:
    """Write df and return figures of its rows, taken in the pass that writes."""
    seen = Observation()
    df.observe(seen, *figures).write.mode("overwrite").parquet(path)
    return seen.get
