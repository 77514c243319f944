"""Summaries kept up to date by signed changes: what changed is read, not the bank.

The state is a table of counts: how many items, and how many of them answered, each chapter has by
marks and year. A change of an item takes one from the counts of what it was and adds one to those
of what it is: adding, deleting, tagging out, answering and correcting are all of that form. Changes
are appended as batches of summed rows; readers sum over batches, and compact() folds them into one.
Years and marks are kept with multiplicities, so deletes take them away with their last item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions.labels import year_range
from itemforge.scratch import drop, materialize

KEYS = ["chapter", "marks", "year"]


def counted(questions: DataFrame, sign: int = 1) -> DataFrame:
    """(chapter, marks, year, n, answered) of questions that are in the syllabus; with sign -1, to be taken away."""
    rows = questions.where(F.coalesce("in_syllabus", F.lit(True))) if "in_syllabus" in questions.columns else questions
    has = (F.coalesce("answer", F.lit("")) != "").cast("long")
    return rows.groupBy(*KEYS).agg((F.count("*") * sign).alias("n"), (F.sum(has) * sign).alias("answered"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed counts of items that change: before holds them as they were, after as they are. An item that is
    only in before goes, one that is only in after is new."""
    return summed(counted(before, -1).union(counted(after)))


def summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("answered").alias("answered"))
    return out.where("n <> 0 or answered <> 0")


@dataclass
class KeptSummary:
    """Counts in numbered batches under a path."""

    spark: SparkSession
    path: str

    @classmethod
    def start(cls, questions: DataFrame, path: str) -> KeptSummary:
        counted(questions).write.mode("overwrite").parquet(f"{path}/batch=0")
        return cls(questions.sparkSession, path)

    def add(self, number: int, delta: DataFrame) -> None:
        """Append changes as batch `number`, from 1 on; writing a batch again replaces it."""
        delta.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def counts(self) -> DataFrame:
        return summed(self.spark.read.parquet(self.path).select(*KEYS, "n", "answered"))

    def compact(self, upto: int) -> None:
        """Fold batches 1 to upto into batch 0. Run while nothing is added."""
        rows = self.spark.read.parquet(self.path)
        past = materialize(summed(rows.where(F.col("batch") <= upto)), "compact")
        past.write.mode("overwrite").parquet(f"{self.path}/batch=0")
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for k in range(1, upto + 1):
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={k}"), True)
        drop(past)

    def chapters(self) -> DataFrame:
        """(name, count, years ascending, marks_dist), as summary.group_summary finds them."""
        fine = self.counts().where("n <> 0")
        by_name = fine.groupBy(F.col("chapter").alias("name")).agg(F.sum("n").alias("count"), F.sort_array(F.collect_set("year")).alias("years"))
        dist = fine.where("marks is not null").groupBy(F.col("chapter").alias("name"), F.col("marks").cast("string").alias("m")).agg(F.sum("n").alias("k"))
        dist = dist.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", "k")))).alias("marks_dist"))
        return by_name.join(dist, "name", "left")

    def stats(self) -> DataFrame:
        """As summary.stats."""
        real = F.when((F.col("year") != 0) & (F.col("n") != 0), F.col("year"))
        rows = self.counts()
        return rows.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.countDistinct(F.when(F.col("n") != 0, F.col("chapter"))).alias("chapters"),
            F.coalesce(F.sum("answered"), F.lit(0)).alias("matched_answers"), year_range(F.min(real), F.max(real)).alias("years"),
        )

    def years(self) -> DataFrame:
        """As summary.facet of the years."""
        return self.counts().where("year <> 0 and n <> 0").select("year").distinct().orderBy(F.desc("year"))
