"""The build of an item bank, as pure functions over DataFrames: extract, mark up, tag, delete, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.functions.labels import chapter_of_file
from itemforge.functions.markup import markup
from itemforge.operators.match import match_answers, upsert_answers
from itemforge.operators.rules import in_syllabus_only, tag
from itemforge.operators.scan import chapter_questions_of, clean_parts, solved_pairs_of
from itemforge.operators.summary import chapter_summary
from itemforge.sources.bank import numbered

#: From so many listed papers on, their list is joined by shuffle.
MANY_PAPERS = 10_000


def extract(chapter_pages: DataFrame, paper_pages: DataFrame, papers: DataFrame) -> DataFrame:
    """Questions with matched answers, from pages (file, page_no, text) and papers (file, year)."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    parts = clean_parts(chapter_pages.select("file", "page_no", "text", chapter_of_file(stem).alias("chapter")), "chapter")
    papers = F.broadcast(papers) if papers.limit(MANY_PAPERS).count() < MANY_PAPERS else papers
    solved = solved_pairs_of(paper_pages.join(papers, "file").select("file", "year", F.col("page_no").cast("long").alias("part"), "text"))
    asked = numbered(chapter_questions_of(parts), F.col("file"), F.col("blk")).drop("file", "blk")
    return match_answers(asked, solved)


def mark_up(questions: DataFrame, faithful: bool = True) -> DataFrame:
    return questions.withColumn("question", markup(F.col("question"), faithful)).withColumn("answer", markup(F.col("answer"), faithful))


def build(chapter_pages: DataFrame, paper_pages: DataFrame, papers: DataFrame, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, chapters): figures of the chapters are derived from what is left."""
    bank = in_syllabus_only(tag(mark_up(extract(chapter_pages, paper_pages, papers))))
    bank = upsert_answers(bank, answers) if answers is not None else bank
    return bank, chapter_summary(bank)
