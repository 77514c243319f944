"""Small derived columns of items, chapters and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chapters in their canonical order, with file key and icon.
CHAPTERS = [
    ("electric-charges-and-fields", "Electric Charges and Fields", "⚡"),
    ("electrostatic-potential", "Electrostatic Potential and Capacitance", "🔋"),
    ("current-electricity", "Current Electricity", "💡"),
    ("moving-charges-and-magnetism", "Moving Charges and Magnetism", "🧲"),
    ("magnetism-and-matter", "Magnetism and Matter", "🔮"),
    ("electromagnetic-induction", "Electromagnetic Induction", "🌊"),
    ("alternating-current", "Alternating Current", "〰️"),
    ("electromagnetic-waves", "Electromagnetic Waves", "📡"),
    ("ray-optics", "Ray Optics and Optical Instruments", "🔭"),
    ("wave-optics", "Wave Optics", "🌈"),
    ("dual-nature", "Dual Nature of Radiation and Matter", "⚛️"),
    ("atoms", "Atoms", "🔬"),
    ("nuclei", "Nuclei", "☢️"),
    ("semiconductor-electronics", "Semiconductor Electronics", "💻"),
]
DEFAULT_ICON = "📚"
# What a chapter file's name holds besides the chapter.
FILE_PREFIX = "class-12-physics-"
FILE_SUFFIXES = [
    "-pyq-1779702121", "-pyq-1779702122", "-pyq-1779702123", "-pyq-1779702124", "-pyq-1779702125", "-pyq-1779702126", "-pyq-1779702127",
]
# Colours by marks, by year and by chapter position.
MARKS_COLOURS = {1: "blue", 2: "green", 3: "purple", 4: "amber", 5: "rose"}
YEAR_COLOURS = ["sky", "violet", "emerald", "orange", "pink"]
CHAPTER_COLOURS = "blue violet emerald amber rose cyan indigo teal orange pink sky lime red purple".split()
PLACEHOLDER = "Refer to the official CBSE"
TIP_LONG = "Write each step clearly with formulae. Derive intermediate results and state units."
TIP_SHORT = "Show substitution of values and intermediate steps for full marks."
SHOWN_MARKS = (1, 2, 3, 5)


def _map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def has_answer(answer: Column) -> Column:
    return F.coalesce((F.length(answer) > 0) & ~F.startswith(answer, F.lit(PLACEHOLDER)), F.lit(False))


def year_colour(year: Column) -> Column:
    return F.get(F.array(*map(F.lit, YEAR_COLOURS)), year % len(YEAR_COLOURS))


def marks_colour(marks: Column) -> Column:
    return F.coalesce(_map(MARKS_COLOURS.items())[marks], F.lit("blue"))


def marks_accent(marks: Column) -> Column:
    out = F.lit("amber")
    for m in (5, 3, 2, 1):
        out = F.when(marks == m, MARKS_COLOURS[m]).otherwise(out)
    return out


def year_shown(year: Column) -> Column:
    return year > 0


def exam_tip(marks: Column) -> Column:
    return F.when(marks == 5, TIP_LONG).when(marks >= 3, TIP_SHORT)


def progress_band(percent: Column) -> Column:
    return F.when(percent == 100, "green").when(percent > 50, "blue").when(percent > 0, "amber").otherwise("gray")


def chapter_icon(name: Column) -> Column:
    return F.coalesce(_map((n, i) for _, n, i in CHAPTERS)[name], F.lit(DEFAULT_ICON))


def chapter_colour(position: Column) -> Column:
    return F.get(F.array(*map(F.lit, CHAPTER_COLOURS)), position % len(CHAPTER_COLOURS))


def marks_badge(marks_dist: Column, marks: int) -> Column:
    return F.coalesce(marks_dist[str(marks)], F.lit(0)) > 0


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def result_label(shown: Column, total: Column) -> Column:
    return F.when(shown == total, F.concat(total.cast("string"), F.lit(" questions"))).otherwise(
        F.concat(shown.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" questions"))
    )


def percent(part: Column, whole: Column) -> Column:
    """Half-up, divided before multiplied; 0 for nothing out of nothing."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100), F.lit(0.0)).cast("long")


def year_range(low: Column, high: Column) -> Column:
    return F.coalesce(F.concat(low.cast("string"), F.lit("–"), high.cast("string")), F.lit(""))


def title_case(c: Column) -> Column:
    """Every run of cased letters with a capital first, as after digits and apostrophes, too."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")


def chapter_of_file(stem: Column) -> Column:
    """The first chapter whose key is in the name, keys in alphabetical order; else the bare name in
    title case."""
    bare = stem
    for part in (FILE_PREFIX, *FILE_SUFFIXES):
        bare = F.replace(bare, F.lit(part), F.lit(""))
    out = title_case(F.replace(bare, F.lit("-"), F.lit(" ")))
    for key, name, _ in sorted(CHAPTERS, reverse=True):
        out = F.when(F.contains(stem, F.lit(key)), name).otherwise(out)
    return out
