"""Cleaning and normalising text: Column to Column, all built-in functions.

Patterns carry (?Ud): \\s, \\d, \\w and \\b follow Unicode, and only \\n ends a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?Ud)"


def rx(c: Column, pattern: str, replacement: str) -> Column:
    """Replace all matches; replacement is in Java's notation."""
    return F.regexp_replace(c, U + pattern, replacement)


def template(text: str) -> str:
    """A Java replacement from plain text in which <n> stands for group n."""
    escaped = text.replace("\\", "\\\\").replace("$", "\\$")
    return reduce(lambda s, n: s.replace(f"<{n}>", f"${n}"), range(1, 10), escaped)


def strip(c: Column) -> Column:
    """Trim all Unicode white space; F.trim takes only spaces."""
    return rx(c, r"^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return strip(rx(c, r"\s+", " "))


# Running head and foot of the pages, and a page number on its own.
PAGE_HEAD = r"Collegedunia \| Class 12 Physics\s*\nChapter[^\n]*\n"
PAGE_FOOT = r"Previous Year Questions • Free download at collegedunia\.com\s*\nPage \d+"
PAGE_NUMBER = r"\nPage \d+\s*\n"


def clean_inside(c: Column) -> Column:
    """Running heads, foots and page numbers go, blank lines collapse."""
    c = rx(rx(rx(c, PAGE_HEAD, ""), PAGE_FOOT, ""), PAGE_NUMBER, "\n")
    return rx(c, r"\n{3,}", "\n\n")


def clean_pages(c: Column) -> Column:
    """Whole text of a file, cleaned and stripped."""
    return strip(clean_inside(c))


def normalize(c: Column) -> Column:
    """Lower case, ASCII letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


def match_key(c: Column, length: int = 80) -> Column:
    return F.substring(normalize(c), 1, length)


def control_clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), "  +", " ")


def contains_ci(c: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test; an empty needle is in every text."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def id_prefix(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def slug(name: Column) -> Column:
    return F.replace(F.replace(id_prefix(name), F.lit(","), F.lit("")), F.lit("/"), F.lit("-"))


def year_or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


MATH = r"\$[^$]+\$"


def segments(c: Column) -> Column:
    """The text cut into $...$ blocks and what lies between; nothing is lost. Only a dollar sign can
    begin a block, so only there is looked ahead."""
    return F.regexp_extract_all(c, F.lit(MATH + r"|(?:[^$]++|\$(?![^$]+\$))++"), F.lit(0))


def is_math(segment: Column) -> Column:
    return F.startswith(segment, F.lit("$")) & F.endswith(segment, F.lit("$")) & (F.length(segment) > 2)


def where_found(c: Column, trigger: str, fn: Callable[[Column], Column]) -> Column:
    """fn(c) where the trigger occurs, c elsewhere. The text is the one element of an array, so that
    it is made once however often it is named."""
    return F.transform(F.array(c), lambda x: F.when(F.rlike(x, F.lit(U + trigger)), fn(x)).otherwise(x))[0]


def map_segments(c: Column, fn: Callable[[Column], Column], math: bool = False) -> Column:
    """Apply fn to the segments outside math blocks (or, with math, to the blocks)."""

    def one(s: Column) -> Column:
        return F.when(is_math(s), fn(s)).otherwise(s) if math else F.when(is_math(s), s).otherwise(fn(s))

    return F.array_join(F.transform(segments(c), one), "")


def map_spans(c: Column, span: str, fn: Callable[[Column], Column], skip: str) -> Column:
    """fn applied to the matches of span, one pass over the text; what lies between stays as it is. skip
    passes by all up to the next span or the end of the text. The text may not hold the character \\x01."""
    pieces = F.split(F.regexp_replace(c, rf"({skip})({span}|\z)", "$1\x01$2\x01"), "\x01", -1)
    return F.array_join(F.transform(pieces, lambda x, k: F.when(k % 2 == 1, fn(x)).otherwise(x)), "")
