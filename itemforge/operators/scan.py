"""Scanners: ordered lines to typed records."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.functions.text import U, clean_inside, clean_pages, collapse, id_prefix, rx, strip, year_or_zero
from itemforge.scratch import materialize

YEAR_TAG = r"\[(\d{4})(?:\s*[•·][^\]]+)?\]"
HEADER = r"(?i)(\d+)-Mark Questions"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def running(df: DataFrame, file: str, n: str, value: Column, name: str) -> DataFrame:
    """With the running sum of value over a file's lines: block numbers, where value marks the breaks."""
    so_far = Window.partitionBy(file).orderBy(n).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value.cast("long")).over(so_far))


def carried(df: DataFrame, file: str, n: str, value: Column, start: Column, name: str) -> DataFrame:
    """With the last value that isn't null up to each line of a file, or start before there is one."""
    so_far = Window.partitionBy(file).orderBy(n).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(so_far), start))


def joined_blocks(df: DataFrame, keys: list[str], n: str, text: Column, *more: Column) -> DataFrame:
    """One row a block, with its lines in order as body."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), text.alias("t")))), lambda x: x["t"])
    return df.groupBy(*keys).agg(F.array_join(lines, "\n").alias("body"), *more)


# Files of any size: a file is a sequence of parts (file, part, text), pages for instance, that its text
# joins with newlines. A scanner is a small machine over lines; a part is read on its own, from every
# state that it may begin in, and so becomes a function from states to states. Functions compose, so one
# short row a part tells the state in which each part really begins; then parts are read once more.

#: Lines of a part that is cut from a longer text.
PART_LINES = 512


def text_parts(docs: DataFrame, *more: str, lines: int | None = None) -> DataFrame:
    """(file, part, text, *more) of docs (file, text, *more): parts of so many lines each."""
    size = PART_LINES if lines is None else lines
    cut = docs.select("file", *more, F.split("text", "\n", -1).alias("all"))
    starts = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / size).cast("int"))
    cut = cut.select("file", "all", *more, F.posexplode(starts).alias("part", "k"))
    return cut.select("file", F.col("part").cast("long").alias("part"), F.array_join(F.slice("all", F.col("k") * size + 1, F.lit(size)), "\n").alias("text"), *more)


@dataclass(frozen=True)
class Machine:
    """step(acc, line) gives the fields of the next acc, a struct of `state` (0 to states - 1) and of kept
    values, null while they are as before the part. kept: their types by name."""

    states: int
    kept: dict[str, str]
    step: Callable[[Column, Column], dict[str, Column]]

    def begin(self, state: Column) -> Column:
        return F.struct(state.cast("int").alias("state"), *(F.lit(None).cast(t).alias(k) for k, t in self.kept.items()))

    def next(self, acc: Column, line: Column) -> Column:
        new = self.step(acc, line)
        types = {"state": "int", **self.kept}
        return F.struct(*(new.get(k, acc[k]).cast(t).alias(k) for k, t in types.items()))

    def function(self, lines: str) -> Column:
        """What the part makes of each state that it may begin in."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.states - 1)), lambda s: F.aggregate(lines, self.begin(s), self.next))

    def entries(self, parts: DataFrame, lines: str, start: Column) -> DataFrame:
        """(file, part, entry): the acc with which each part begins. start: that of a file."""
        each = parts.select("file", F.struct("part", self.function(lines).alias("f")).alias("p")).groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("ps"))
        kinds = ", ".join(f"{k}: {t}" for k, t in {"state": "int", **self.kept}.items())
        none = F.array().cast(f"array<struct<part: bigint, entry: struct<{kinds}>>>")

        def put(acc: Column, p: Column) -> Column:
            to = F.get(p["f"], acc["now"]["state"])
            now = F.struct(to["state"].alias("state"), *(F.coalesce(to[k], acc["now"][k]).alias(k) for k in self.kept))
            return F.struct(now.alias("now"), F.array_append(acc["all"], F.struct(p["part"].alias("part"), acc["now"].alias("entry"))).alias("all"))

        found = F.aggregate("ps", F.struct(start.alias("now"), none.alias("all")), put, lambda acc: acc["all"])
        return each.select("file", F.explode(found).alias("e")).select("file", "e.part", "e.entry")

    def read(self, parts: DataFrame, lines: str, start: Column) -> DataFrame:
        """parts with accs, the acc after each of their lines."""
        entries = self.entries(parts, lines, start)
        every = F.aggregate(lines, F.array("entry"), lambda acc, line: F.array_append(acc, self.next(F.element_at(acc, -1), line)))
        return parts.join(entries, ["file", "part"]).withColumn("accs", F.slice(every, F.lit(2), F.size(lines))).drop("entry")


def _placed(part: str, k: Column) -> Column:
    """A line's place in its file: later parts and lines have larger ones."""
    return F.shiftleft(F.col(part), 32).bitwiseOR(k.cast("long"))


def _ranked(df: DataFrame, group: str) -> DataFrame:
    """df (group, file, at, ...) with rank from 1 in the group by file and at: the rows of a part are ranked
    together and the counts of parts before are added, so no task ranks a whole group."""
    part, keys = F.shiftright("at", 32), [*dict.fromkeys([group, "file"])]
    sizes = df.groupBy(*keys, part.alias("in_part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("file", "in_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "in_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "in_part").orderBy("at"))
    ranked = df.withColumn("in_part", part).withColumn("inside", inside).join(base, [*keys, "in_part"])
    return ranked.withColumn("rank", F.col("base") + F.col("inside")).drop("in_part", "inside", "base")


def part_lines(parts: DataFrame) -> DataFrame:
    """(file, n, line): the lines of files in parts (file, part, text), numbered from 0."""
    lines = parts.select("file", "part", F.split("text", "\n", -1).alias("lines"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.select("file", "part", F.size("lines").alias("n"))  # one short row a part
    base = sizes.select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = lines.join(base, ["file", "part"]).select("file", "base", F.posexplode("lines").alias("k", "line"))
    return rows.select("file", (F.col("base") + F.col("k")).alias("n"), "line")


def chapter_questions(docs: DataFrame, intended: bool = False) -> DataFrame:
    """Questions of chapter texts (file, chapter, text); see chapter_questions_of."""
    cleaned = docs.select("file", "chapter", clean_pages(F.col("text")).alias("text"))
    return chapter_questions_of(text_parts(cleaned, "chapter"), intended)


def chapter_questions_of(parts: DataFrame, intended: bool = False) -> DataFrame:
    """Questions of chapters in cleaned parts (file, chapter, part, text), in the order of parts.

    Lines fall into blocks that begin at Qn. A block is a question if its first line has text after
    the mark and is no marks header. Marks carry forward from headers outside question blocks
    (faithful) or from any header (intended, which also leaves header lines out of bodies). Ids
    number the kept questions of a chapter, file after file.
    """

    def line(x: Column, k: Column) -> Column:
        t = strip(x)
        header = _found(t, U + HEADER).cast("int")
        opens = F.rlike(t, F.lit(U + r"^Q\d+\.\s+")) & header.isNull()
        body = F.when(opens, F.regexp_extract(t, U + r"^Q\d+\.\s+(.*)", 1)).otherwise(t)
        return F.struct(k.alias("k"), F.rlike(t, F.lit(U + r"^Q\d+\.")).alias("brk"), header.alias("hdr"), opens.alias("opens"), body.alias("body"))

    def step(acc: Column, x: Column) -> dict[str, Column]:
        # A start without a body text ("Q1. " is stripped) is only a break.
        state = F.when(x["brk"], F.when(x["opens"], 1).otherwise(0)).otherwise(acc["state"])
        heard = x["hdr"].isNotNull() if intended else x["hdr"].isNotNull() & (state == 0)
        return {"state": state, "marks": F.when(heard, x["hdr"]).otherwise(acc["marks"]), "opened": F.when(x["brk"], x["at"]).otherwise(acc["opened"])}

    machine = Machine(2, {"marks": "int", "opened": "bigint"}, step)
    lines = F.transform(F.split("text", "\n", -1), line)
    lines = F.transform(lines, lambda x: x.withField("at", _placed("part", x["k"])))
    start = F.struct(F.lit(0).alias("state"), F.lit(1).alias("marks"), F.lit(0).cast("bigint").alias("opened"))
    read = machine.read(parts.select("file", "chapter", "part", lines.alias("lines")), "lines", start)
    rows = read.select("file", "chapter", F.inline(F.arrays_zip("lines", "accs")))
    rows = rows.select("file", "chapter", "lines.*", "accs.state", "accs.marks", "accs.opened")
    body = rows.where(F.col("state") == 1 if not intended else (F.col("state") == 1) & F.col("hdr").isNull())
    blocks = joined_blocks(body, ["file", "chapter", "opened"], "at", F.col("body"), F.min_by("marks", "at").alias("marks")).withColumn("full", strip(F.col("body")))
    year = _found(F.col("full"), U + YEAR_TAG).cast("int")
    asked = blocks.select("file", "chapter", F.col("opened").alias("at"), "marks", year_or_zero(year).alias("year"), collapse(rx(F.col("full"), YEAR_TAG, "")).alias("question"))
    asked = _ranked(asked.where(F.length("question") > 15), "chapter")
    return asked.select(
        "file", F.col("at").alias("blk"), F.concat(id_prefix(F.col("chapter")), F.lit("-"), F.col("rank").cast("string")).alias("id"), "chapter", "marks", "year", "question",
        F.lit(None).cast("string").alias("answer"), F.lit(False).alias("bookmarked"), F.lit(False).alias("solved"),
    )


# Page borders. A line is plain if no page head, foot or number and no blank can touch it. Between the
# second and the third of three plain lines in a row nothing that is cleaned away can lie across.
TOUCHED = "Collegedunia|Chapter|Previous Year Questions|Page"


def clean_parts(pages: DataFrame, *more: str) -> DataFrame:
    """(file, part, text, *more): the parts of cleaned files, from pages (file, page_no, text, *more) that
    their text joins with newlines, and one after the last. more: constant in a file.

    Each page is cut behind the first and before the last place between plain lines, and cleaned between
    them; what is left of it is stitched to the ends of its neighbours and cleaned as one text. Joined
    with newlines the parts are the text that clean_pages gives for the whole file. Pages have numbers of
    their own in a file; those without a text are left out.
    """
    lines = pages.where("text is not null").select("file", "page_no", *more, F.split("text", "\n", -1).alias("lines"))
    plain = F.transform("lines", lambda x: F.rlike(x, F.lit(r"(?U)[^\s]")) & ~F.rlike(x, F.lit(TOUCHED)))
    lines = lines.withColumn("plain", plain)
    three = F.filter(F.sequence(F.lit(0), F.size("plain") - 3), lambda k: F.get("plain", k) & F.get("plain", k + 1) & F.get("plain", k + 2))
    lines = lines.withColumn("safe", F.when(F.size("plain") >= 3, three))
    lines = lines.select("file", "page_no", *more, "lines", (F.array_min("safe") + 2).alias("first"), (F.array_max("safe") + 2).alias("last"))
    # Borders are numbered by the pages before that have a place to cut: one short row a page.
    cut = F.col("first").isNotNull()
    cuts = lines.select("file", "page_no", cut.cast("long").alias("cut"))
    before = Window.partitionBy("file").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    border, final = F.coalesce(F.sum("cut").over(before), F.lit(0)), F.sum("cut").over(Window.partitionBy("file"))
    borders = cuts.select("file", "page_no", (2 * border).alias("part"), (2 * final).alias("final"))

    def some(step: int, a: Column, b: Column) -> Column:
        return F.struct((F.col("part") + step).alias("part"), F.array_join(F.slice("lines", a + 1, b - a), "\n").alias("text"))

    first, last, n = F.col("first"), F.col("last"), F.size("lines")
    pieces = F.when(cut, F.array(some(0, F.lit(0), first), some(1, first, last), some(2, last, n))).otherwise(F.array(some(0, F.lit(0), n)))
    found = lines.join(borders, ["file", "page_no"]).select("file", "page_no", "final", *more, F.explode(pieces).alias("p"))
    found = found.select("file", "page_no", "final", *more, "p.part", "p.text")
    # Between the first place and the last there may be nothing.
    odd = F.col("part") % 2 == 1
    inner = found.where(odd & (F.col("text") != "")).select("file", "part", "text", *more)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"])
    outer = found.where(~odd).groupBy("file", "part", "final", *more).agg(F.array_join(ordered, "\n").alias("text"))
    ended = F.when(F.col("part") == F.col("final"), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    cleaned = inner.union(outer.select("file", "part", ended.alias("text"), *more)).withColumn("text", clean_inside(F.col("text")))
    cleaned = materialize(cleaned, "clean-parts")  # read for the ends and by the scanners more than once
    # The file's first and last character that isn't white space bound it.
    ends = cleaned.where(F.rlike("text", F.lit(r"(?U)[^\s]"))).groupBy("file").agg(F.min("part").alias("head"), F.max("part").alias("tail"))
    kept = cleaned.join(ends, "file", "left").withColumns({"head": F.coalesce("head", F.lit(0)), "tail": F.coalesce("tail", F.lit(0))}).where("part between head and tail")
    text = F.when(F.col("part") == F.col("head"), rx(F.col("text"), r"^\s+", "")).otherwise(F.col("text"))
    return kept.withColumn("text", text).select("file", "part", F.when(F.col("part") == F.col("tail"), rx(F.col("text"), r"\s+\z", "")).otherwise(F.col("text")).alias("text"), *more)


#: White space as the scanner of solved papers knows it.
SPACE = r"[\s\x1c-\x1f]"
LAST_QUESTION = 35
ANSWERING = LAST_QUESTION + 1
#: Decimal digits of all scripts and their values, by Unicode's own data.
DIGITS = [c for c in map(chr, range(128, sys.maxunicode)) if unicodedata.category(c) == "Nd"]
DIGIT_VALUES = "".join(str(unicodedata.digit(c)) for c in DIGITS)
DIGITS = "".join(DIGITS)


def solved_pairs(docs: DataFrame) -> DataFrame:
    """Question and answer pairs of solved papers (file, year, text); see solved_pairs_of."""
    return solved_pairs_of(text_parts(docs, "year"))


def solved_pairs_of(parts: DataFrame) -> DataFrame:
    """Question and answer pairs of solved papers in parts (file, year, part, text).

    The scanner is outside, in a question (until its answer or the next number), or in an answer (until
    any numbered line, which is then read as from outside): 37 states, as a question's number decides
    which line ends it.
    """

    def line(x: Column, k: Column) -> Column:
        number = _found(x, rf"{U}^{SPACE}*(\d+)\.{SPACE}+(?:.*)")
        answer = F.rlike(x, F.lit(rf"{U}^{SPACE}*Ans\."))
        bare = F.rlike(x, F.lit(rf"{U}^{SPACE}*\d+\.\z"))
        # Numbers beyond an int are no question's number.
        value = F.when(number.isNotNull(), F.coalesce(F.translate(number, DIGITS, DIGIT_VALUES).try_cast("int"), F.lit(0)))
        text = F.when(number.isNotNull(), F.regexp_extract(x, rf"{U}^{SPACE}*\d+\.{SPACE}+(.*)", 1)).when(answer, F.regexp_extract(x, rf"{U}^{SPACE}*Ans\.{SPACE}*(.*)", 1))
        return F.struct(k.alias("k"), value.alias("num"), answer.alias("ans"), bare.alias("bare"), x.alias("line"), text.alias("text"))

    def step(acc: Column, x: Column) -> dict[str, Column]:
        asking, answering = acc["state"].between(1, LAST_QUESTION), acc["state"] == ANSWERING
        ends = F.when(asking, F.coalesce(x["num"] == acc["state"] + 1, F.lit(False))).when(answering, x["num"].isNotNull() | x["bare"]).otherwise(True)
        opens = F.coalesce(x["num"].between(1, LAST_QUESTION), F.lit(False))
        outside = F.when(opens, x["num"]).otherwise(0)
        state = F.when(asking & x["ans"], ANSWERING).when(ends, outside).otherwise(acc["state"])
        begins = ends & opens
        return {
            "state": state, "opened": F.when(begins, x["at"]).otherwise(acc["opened"]), "number": F.when(begins, x["num"]).otherwise(acc["number"]),
            "replied": F.when(asking & x["ans"], x["at"]).otherwise(acc["replied"]),
        }

    machine = Machine(LAST_QUESTION + 2, {"opened": "bigint", "number": "int", "replied": "bigint"}, step)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line)
    lines = F.transform(lines, lambda x: x.withField("at", _placed("part", x["k"])))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("opened"), F.lit(0).alias("number"), F.lit(-1).cast("bigint").alias("replied"))
    read = machine.read(parts.select("file", "year", "part", lines.alias("lines")), "lines", start)
    rows = read.select("file", "year", F.inline(F.arrays_zip("lines", "accs"))).where("accs.state > 0")
    rows = rows.select("file", "year", "lines.*", "accs.opened", "accs.replied", F.col("accs.number").alias("q_num"), (F.col("accs.state") == ANSWERING).alias("answering"))
    # The line that opens a question, and that which begins its answer, give what follows the mark.
    first = (F.col("at") == F.col("opened")) | (F.col("at") == F.col("replied"))
    rows = rows.withColumn("part_text", F.when(first, F.col("text")).otherwise(F.col("line")))

    def joined(which: Column) -> Column:
        own = F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("at", "part_text")))), lambda x: x["part_text"])
        return F.regexp_replace(F.regexp_replace(F.array_join(own, " "), rf"{U}{SPACE}+", " "), r"^ | \z", "")

    pairs = rows.groupBy("file", "year", F.col("opened").alias("at"), "q_num").agg(joined(~F.col("answering")).alias("question"), F.nullif(joined(F.col("answering")), F.lit("")).alias("answer"))
    pairs = _ranked(pairs.where(F.length("question") > 10), "file")
    return pairs.select("file", (F.col("rank") - 1).cast("int").alias("pair_ord"), "year", "q_num", "question", "answer")


OPTION = r"(?i)^Option\s*\(([A-D])\)\s+is\s+correct\.?\s*"
SHORT = r"(?i)^\(([A-D])\)\s+(.{0,120})\z"
PARTS = r"\n(?=Step\s*\d|\(\s*[ivxIVXa-z]+\s*\)|\d+[.)]\s)"
STEP = r"(?i)^(Step\s*\d+[:.)]|\(\s*[ivxa-z]+\s*\)|\d+[.)]\s)"


def _segment(kind: str, content: Column, label: Column | None = None) -> Column:
    label = F.lit(None).cast("string") if label is None else label
    return F.struct(F.lit(kind).alias("type"), content.alias("content"), label.alias("label"))


def answer_segments(answer: Column) -> Column:
    """array<struct<type, content, label>>: options, steps, notes and plain text of an answer."""
    text = strip(answer)
    option = F.upper(_found(text, OPTION))
    rest = F.when(option.isNotNull(), strip(rx(text, OPTION, ""))).otherwise(text)
    short = F.when(option.isNull(), F.upper(_found(text, SHORT)))
    lead = r"(?i)^Explanation[:\s]+"
    rest = F.when(F.rlike(rest, F.lit(U + lead)), strip(rx(rest, lead, ""))).otherwise(rest)
    parts = F.split(rest, U + PARTS, -1)

    def step(p: Column) -> Column:
        label = F.regexp_extract(p, U + STEP, 1)
        content = strip(F.substring(p, F.length(label) + 1, F.length(p)))
        return F.when(label != "", _segment("step", content, strip(label))).otherwise(_segment("plain", strip(p)))

    note_at = F.regexp_instr(rest, F.lit(r"(?i)\bNote\s*:"))
    note = strip(rx(F.substring(rest, note_at, F.length(rest)), r"(?i)^Note\s*:\s*", ""))
    single = F.when(
        note_at > 1, F.array(_segment("plain", strip(F.substring(rest, F.lit(1), note_at - 1))), _segment("note", note))
    ).otherwise(F.array(_segment("plain", rest)))
    body = F.when(F.size(parts) > 1, F.transform(parts, step)).otherwise(single)
    head = F.when(option.isNotNull(), F.array(_segment("option", F.concat(F.lit("Option ("), option, F.lit(") is correct")), option)))
    whole = F.concat(F.coalesce(head, F.array().cast("array<struct<type:string,content:string,label:string>>")), body)
    brief = F.array(_segment("option", F.concat(F.lit("("), short, F.lit(") "), F.regexp_extract(text, U + SHORT, 2)), short))
    return F.filter(F.when(short.isNotNull(), brief).otherwise(whole), lambda s: strip(s["content"]) != "")
