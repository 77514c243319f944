"""One object with the queries that a reader of the bank runs. Every method returns a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import labels as lab
from itemforge.operators import search, state, summary
from itemforge.sources.bank import read_bank


@dataclass
class ItemBank:
    questions: DataFrame  # schemas.QUESTION
    chapters: DataFrame  # schemas.CHAPTER

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ItemBank:
        return cls(*read_bank(spark, path))

    @classmethod
    def of(cls, questions: DataFrame) -> ItemBank:
        """With chapters derived from the questions, so their figures are never stale."""
        derived = summary.chapter_summary(questions)
        rank = F.coalesce(F.col("place"), F.lit(1 << 20) + F.col("first"))
        return cls(questions, derived.select(rank.cast("long").alias("ord"), "name", "count", "years", "marks_dist", "slug"))

    def register(self, spark: SparkSession) -> None:
        """As views, for SQL."""
        self.questions.createOrReplaceTempView("questions")
        self.chapters.createOrReplaceTempView("chapters")

    def all_questions(self) -> DataFrame:
        return self.questions.orderBy("ord")

    def all_chapters(self) -> DataFrame:
        return self.chapters.orderBy("ord")

    def summary(self) -> DataFrame:
        """Chapter cards, in order."""
        badges = [lab.marks_badge(F.col("marks_dist"), m).alias(f"has_{m}") for m in lab.SHOWN_MARKS]
        span = lab.year_range(F.array_min("years"), F.array_max("years")).alias("year_range")
        return self.chapters.select("ord", "name", "slug", "count", lab.chapter_icon(F.col("name")).alias("icon"), lab.chapter_colour(F.col("ord")).alias("colour"), span, *badges).orderBy("ord")

    def stats(self) -> DataFrame:
        return summary.stats(self.questions)

    def years(self) -> DataFrame:
        return summary.facet(self.questions, "year")

    def total(self) -> DataFrame:
        return summary.total_count(self.chapters)

    def chapter(self, slug: str) -> DataFrame:
        return search.lookup(self.chapters, "slug", slug)

    def question(self, id: str) -> DataFrame:
        return search.lookup(self.questions, "id", id)

    def of_chapter(self, slug: str, marks=None, year=None, text: str = "") -> DataFrame:
        """The matching questions of the chapter with this slug; none for an unknown slug."""
        name = self.chapter(slug).select(F.col("name").alias("chapter"))
        found = search.chapter_matching(self.questions, None, marks, year, text)
        return found.join(F.broadcast(name), "chapter", "left_semi")  # one row at most

    def chapter_page(self, slug: str, marks=None, year=None, text: str = "", page: int = 1) -> DataFrame:
        return search.page(self.of_chapter(slug, marks, year, text), page, search.CHAPTER_PAGE)

    def search(self, chapter=None, year=None, marks=None, text=None, page: int = 1) -> DataFrame:
        return search.search(self.questions, chapter, year, marks, text, page)

    def bookmarked(self, ids: DataFrame) -> DataFrame:
        return state.members(self.questions, ids)

    def progress(self, solved: DataFrame) -> DataFrame:
        return state.chapter_progress(self.chapters, self.questions, solved)

    def overall_progress(self, solved: DataFrame) -> DataFrame:
        return state.overall_progress(self.questions, solved)
