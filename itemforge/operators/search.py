"""Interactive queries: conjunctive filters, literal search, paging and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import contains_ci

SEARCH_PAGE, CHAPTER_PAGE = 15, 20


def _conditions(text_column: str, group_column: str, year_column: str, marks_column: str, group, year, marks, text) -> list[Column]:
    """Equality first: it reaches the scan. Numbers are cast as parameters, never as columns."""
    found = []
    if group:
        found.append(F.col(group_column) == group)
    if year not in (None, ""):
        found.append(F.col(year_column) == int(year))
    if marks not in (None, ""):
        found.append(F.col(marks_column) == int(marks))
    if text:
        found.append(contains_ci(F.col(text_column), text))
    return found


def matching(questions: DataFrame, chapter=None, year=None, marks=None, text=None, names=("question", "chapter", "year", "marks")) -> DataFrame:
    """Global search: all given criteria hold; with none there is no result. The needle is trimmed."""
    q, c, y, m = names
    found = _conditions(q, c, y, m, chapter, year, marks, (text or "").strip())
    return questions.where(reduce(Column.__and__, found)) if found else questions.limit(0)


def page(df: DataFrame, number: int, size: int, order: str = "ord") -> DataFrame:
    """Pages 1 to number, in stored order: a distributed top-k."""
    return df.orderBy(order).limit(number * size)


def search(questions: DataFrame, chapter=None, year=None, marks=None, text=None, number: int = 1, size: int = SEARCH_PAGE) -> DataFrame:
    return page(matching(questions, chapter, year, marks, text), number, size)


def chapter_matching(questions: DataFrame, chapter: str | None, marks=None, year=None, text: str = "") -> DataFrame:
    """Within a chapter: with no criteria everything; a blank needle is none, another isn't trimmed."""
    needle = text if text.strip() else None
    found = _conditions("question", "chapter", "year", "marks", chapter, year, marks, needle)
    return questions.where(reduce(Column.__and__, found)) if found else questions


def chapter_page(questions: DataFrame, chapter: str, marks=None, year=None, text: str = "", number: int = 1, size: int = CHAPTER_PAGE) -> DataFrame:
    return page(chapter_matching(questions, chapter, marks, year, text), number, size)


def remaining(df: DataFrame, number: int, size: int) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("n"), F.greatest(n - number * size, F.lit(0)).alias("remaining"))


def lookup(df: DataFrame, column: str, value, order: str = "ord") -> DataFrame:
    """The first match in stored order, or none."""
    return df.where(F.col(column) == value).orderBy(order).limit(1)


def sample_head(df: DataFrame, condition: Column, n: int, order: str = "ord") -> DataFrame:
    return df.where(condition).orderBy(order).limit(n)


def display_index(shown: DataFrame, order: str = "ord") -> DataFrame:
    """Positions in a shown page, which its size bounds."""
    return shown.withColumn("index", F.row_number().over(Window.orderBy(order)) - 1)
