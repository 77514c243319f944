import glob
import json
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from itemforge.functions import markup as mk
from itemforge.functions import text as tx
from itemforge.operators import deltas, generation, match, rules, scan, search, state, stored, summary
from itemforge.plans.bank import ItemBank
from itemforge.plans.pipeline import build, extract
from itemforge.sources import bank
from itemforge.streaming import toggle_state, toggles


def questions(spark, rows):
    return spark.createDataFrame(rows, "ord long, id string, chapter string, marks int, year int, question string, answer string")


@pytest.fixture(scope="module")
def few(spark):
    return questions(
        spark,
        [
            (0, "a-1", "Atoms", 1, 2019, "What is flux in a field?", None),
            (1, "a-2", "Atoms", 2, 0, "The Potentiometer wire", "x"),
            (2, "c-1", "Current Electricity", 2, 2020, "The Potentiometer wire", ""),
            (3, "c-2", "Current Electricity", 5, 2019, "Colour code and potentiometer", None),
        ],
    )


CHAPTER_TEXT = (
    "1-Mark Questions\nQ1. What is flux? [2019]\nmore\n2-Mark Questions\nQ2. Define capacitance fully [2020 • Delhi]\nQ3.\n"
    "3-Mark Questions\nQ4. Short [2021]\nQ5. Explain total internal reflection"
)
PAPER_TEXT = (
    "1. State Gauss law now\n7. still the first question\nAns. Flux is\ncharge over epsilon\n2. Define ohm precisely\n"
    "3. Third question text\nAns. yes\n99. stops the answer\nignored"
)
ANSWERS = ["Option (b) is correct. Because x", "(c) Some text", "Intro\nStep 1: a\n2) c", "Body text. Note: units", "Note: units", "Explanation: because"]


def test_chapter_scan(spark):
    docs = spark.createDataFrame([("a.pdf", "Atoms", CHAPTER_TEXT)], "file string, chapter string, text string")
    got = [(r.id, r.marks, r.year, r.question) for r in scan.chapter_questions(docs).orderBy("id").collect()]
    assert got == [
        ("atoms-1", 1, 2019, "What is flux? more 2-Mark Questions"),
        ("atoms-2", 1, 2020, "Define capacitance fully"),
        ("atoms-3", 3, 0, "Explain total internal reflection"),
    ]


def plain_scan(text):
    """The block rules, read line by line."""
    out, marks, block = [], 1, None
    for line in map(str.strip, text.split("\n")):
        if re.match(r"Q\d+\.", line):
            if block:
                out.append(block)
            start = re.match(r"Q\d+\.\s+(.*)", line)
            head = re.search(r"(\d+)-Mark Questions", line)
            block = (marks, [start[1]]) if start and not head else None
            marks = int(head[1]) if head else marks
        elif block:
            block[1].append(line)
        else:
            head = re.search(r"(\d+)-Mark Questions", line)
            marks = int(head[1]) if head else marks
    texts = [(m, " ".join("\n".join(b).split())) for m, b in [*out, *([block] if block else [])]]
    return [(m, t) for m, t in texts if len(t) > 15]


def test_chapter_scan_random(spark):
    rng = random.Random(5)
    lines = ["Q1. a long enough question", "Q2.", "Q3. short", "2-Mark Questions", "text line here", "", "Q4. 3-Mark Questions", "  more words follow"]
    texts = ["\n".join(["x", *(rng.choice(lines) for _ in range(rng.randrange(1, 12))), "y"]) for _ in range(60)]
    docs = spark.createDataFrame([(f"{k:03}", f"C{k:03}", t) for k, t in enumerate(texts)], "file string, chapter string, text string")
    got = {}
    for r in scan.chapter_questions(docs).orderBy("file", "blk").collect():
        got.setdefault(r.file, []).append((r.marks, r.question))
    assert got == {f"{k:03}": s for k, t in enumerate(texts) if (s := plain_scan(t))}


def test_solved_scan(spark):
    docs = spark.createDataFrame([("p.pdf", 2020, PAPER_TEXT)], "file string, year int, text string")
    got = [(r.q_num, r.question, r.answer) for r in scan.solved_pairs(docs).orderBy("pair_ord").collect()]
    assert got == [
        (1, "State Gauss law now 7. still the first question", "Flux is charge over epsilon"),
        (2, "Define ohm precisely", None),
        (3, "Third question text", "yes"),
    ]


NUMBERED, ANSWERED = re.compile(r"^\s*(\d+)\.\s+(.*)"), re.compile(r"^\s*Ans\.\s*(.*)")


def plain_pairs(lines):
    """A solved paper read line by line."""
    out, number, asked, answer = [], 0, [], None

    def close():
        question = " ".join(" ".join(asked).split())
        if len(question) > 10:
            out.append((number, question, " ".join(" ".join(answer or []).split()) or None))

    for line in lines:
        m, a, token = NUMBERED.match(line), ANSWERED.match(line), line.split()[:1]
        if number and answer is None:
            if a:
                answer = [a[1]]
                continue
            if not (m and int(m[1]) == number + 1):
                asked.append(line.strip())
                continue
            close()
        elif number:
            if not m and not (token and re.match(r"^\d+\.$", token[0])):
                answer.append(line.strip())
                continue
            close()
        number, asked, answer = 0, [], None
        if m and 1 <= int(m[1]) <= 35:
            number, asked = int(m[1]), [m[2]]
    if number:
        close()
    return out


PAPER_LINES = [
    "1. first question text", "2. second question text", "  3. third one, rather long", "Ans. an answer", "Ans.", " Ans.  another ", "4.", "12. far", "40. out of range", "word word", "", "\x1c", "\u0662. by other digits",
    "99999999999. huge", "35. the last question", "36. too far", "0. zero is none", "5.\x1dseparated by a mark", "\u00a01.\u00a0blanks of another kind", "\r", "007. spelled with zeros",
]


@pytest.mark.parametrize("size", [1, 2, 7, 512])
def test_solved_scan_random_at_every_part_size(spark, size):
    rng = random.Random(size)
    texts = ["\n".join(rng.choice(PAPER_LINES) for _ in range(rng.randrange(40))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame([(f"{k:03}", 2000 + k, t) for k, t in enumerate(texts)], "file string, year int, text string")
    got = {}
    for r in scan.solved_pairs_of(scan.text_parts(docs, "year", lines=size)).orderBy("file", "pair_ord").collect():
        assert r.year == 2000 + int(r.file) and r.pair_ord == len(got.setdefault(r.file, []))
        got[r.file].append((r.q_num, r.question, r.answer))
    assert got == {f"{k:03}": s for k, t in enumerate(texts) if (s := plain_pairs((t or "").split("\n")))}


def test_solved_scan_of_a_long_file_in_many_parts(spark):
    # 200,000 lines in 400 parts, in which most questions and answers cross part borders.
    pages = spark.range(0, 400, 1, 8).select(
        F.lit("p").alias("file"), F.lit(2020).alias("year"), F.col("id").alias("part"),
        F.expr("array_join(transform(sequence(0, 499), k -> CASE (id * 500 + k) % 700 WHEN 3 THEN '1. a question to be asked' WHEN 350 THEN 'Ans. so' ELSE concat('w', k) END), char(10))").alias("text"),
    )
    text = "\n".join(r.text for r in pages.orderBy("part").collect())
    read = scan.solved_pairs_of(pages)
    got = [(r.q_num, r.question, r.answer) for r in read.orderBy("pair_ord").collect()]
    assert got == plain_pairs(text.split("\n")) and len(got) > 1


@pytest.mark.parametrize("intended", [False, True])
def test_chapter_scan_at_every_part_size(spark, intended):
    rng = random.Random(6)
    lines = ["Q1. a long enough question", "Q2.", "Q3. short", "2-Mark Questions", "text line here", "", "Q4. 3-Mark Questions", "  more words follow", "[2021] year of it"]
    texts = ["\n".join(["x", *(rng.choice(lines) for _ in range(rng.randrange(1, 30))), "y"]) for _ in range(60)]
    docs = spark.createDataFrame([(f"{k:03}", f"C{k % 7}", t) for k, t in enumerate(texts)], "file string, chapter string, text string")
    names = ["file", "id", "chapter", "marks", "year", "question"]
    whole, *others = (sorted(map(tuple, scan.chapter_questions_of(scan.text_parts(docs, "chapter", lines=n), intended).select(*names).collect())) for n in (512, 1, 5))
    assert len(whole) > 50 and all(o == whole for o in others)


PAGE_LINES = [
    "Collegedunia | Class 12 Physics", "Chapter 3", "Previous Year Questions • Free download at collegedunia.com", "Page 4", "", "  ", "plain words", "more", "text", "x Collegedunia | Class 12 Physics ",
    "Page", "Pa", "ge 5", "plain", "words again",
]


def test_page_parts_are_the_cleaned_text(spark):
    rng = random.Random(9)
    files = [["\n".join(rng.choice(PAGE_LINES) for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 6))] for _ in range(250)]
    files += [["", ""], ["\n\n"], ["a"], ["\n\na\nb\nc\nd\n\n", "\n\n\n"]]
    rows = [(f"{k:03}", n, t) for k, pages in enumerate(files) for n, t in enumerate(pages)]
    pages = spark.createDataFrame([*rows, ("000", 99, None)], "file string, page_no int, text string")
    want = {r.file: r.t for r in bank.document_text(pages).select("file", tx.clean_pages(F.col("text")).alias("t")).collect()}
    parts = scan.clean_parts(pages)
    got = {}
    for r in parts.orderBy("file", "part").collect():
        got.setdefault(r.file, []).append(r.text)
    assert {f: "\n".join(t) for f, t in got.items()} == want
    assert parts.groupBy("file").count().agg(F.max("count")).first()[0] > 3
    lines = {}
    for r in scan.part_lines(parts).orderBy("file", "n").collect():
        assert r.n == len(lines.setdefault(r.file, []))
        lines[r.file].append(r.line)
    assert {f: "\n".join(t) for f, t in lines.items()} == want


def test_answer_segments(spark):
    got = {}
    rows = spark.createDataFrame([*enumerate(ANSWERS)], "ord int, answer string")
    for r in rows.select("ord", F.posexplode(scan.answer_segments(F.col("answer"))).alias("pos", "s")).select("ord", "pos", "s.*").orderBy("ord", "pos").collect():
        got.setdefault(r.ord, []).append((r.type, r.label, r.content))
    assert list(got.values()) == [
        [("option", "B", "Option (B) is correct"), ("plain", None, "Because x")],
        [("option", "C", "(C) Some text")],
        [("plain", None, "Intro"), ("step", "Step 1:", "a"), ("step", "2)", "c")],
        [("plain", None, "Body text."), ("note", None, "units")],
        [("plain", None, "Note: units")],
        [("plain", None, "because")],
    ]


def test_rules(spark, few):
    tagged = rules.tag(few)
    assert {r.id: r.removed_reason for r in tagged.collect()} == {"a-1": None, "a-2": None, "c-1": "Potentiometer", "c-2": "Carbon Resistors & Colour Code"}
    by_table = rules.tag_by_table(few, rules.rule_table(spark))
    assert {tuple(r) for r in by_table.collect()} == {(r.id, r.removed_reason) for r in tagged.collect()}
    assert [r.id for r in rules.missing_answers(tagged).collect()] == ["a-1"]
    assert [r.removed_reason for r in rules.reason_counts(tagged).collect()] == ["Potentiometer", "Carbon Resistors & Colour Code"]


@pytest.mark.parametrize("size", [0, 1 << 25])
def test_rules_by_shuffle_and_by_broadcast(spark, few, monkeypatch, size):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", size)
    own = [("Current Electricity", ["potentiometer"], "P"), (None, ["flux", "?"], "F")]
    got = {tuple(r) for r in rules.tag_by_table(few, rules.rule_table(spark, own)).collect()}
    assert got == {("a-1", "F"), ("a-2", None), ("c-1", "P"), ("c-2", "P")}
    assert {r.removed_reason for r in rules.tag_by_table(few, rules.rule_table(spark, own).limit(0)).collect()} == {None}


def test_match_last_file_wins(spark):
    q = questions(spark, [(0, "a-1", "Atoms", 1, 2022, "Define: the Ohm!", "old"), (1, "a-2", "Atoms", 1, 0, "other", "kept")])
    rows = [("I", 0, 2022, "define the ohm", "first"), ("II", 0, 2022, "Define the ohm", "second"), ("III", 0, 2022, "Define the ohm", None)]
    solved = spark.createDataFrame(rows, "file string, pair_ord int, year int, question string, answer string")
    assert {r.id: r.answer for r in match.match_answers(q, solved).collect()} == {"a-1": "second", "a-2": "kept"}


def test_search_and_pages(few, spark):
    assert search.search(few).count() == 0
    assert search.chapter_matching(few, "Atoms").count() == 2
    assert [r.id for r in search.search(few, text=" potentiometer ", marks="2").collect()] == ["a-2", "c-1"]
    assert search.chapter_matching(few, "Atoms", text="flux in ").count() == 1
    assert search.chapter_matching(few, "Atoms", text="field? ").count() == 0
    many = spark.range(47).withColumnRenamed("id", "ord")
    assert search.page(many, 2, 15).count() == 30
    assert search.remaining(many, 2, 15).first().remaining == 17


def test_pushdown(few, tmp_path):
    few.write.parquet(str(tmp_path / "q"))
    found = search.matching(few.sparkSession.read.parquet(str(tmp_path / "q")), chapter="Atoms", year="2019").select("ord")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(year,2019)" in plan and "EqualTo(chapter,Atoms)" in plan and "question" not in plan.split("ReadSchema")[1]


def test_summary(few):
    rows = summary.chapter_summary(few).collect()
    assert [(r.name, r["count"], r.years, r.marks_dist, r.slug) for r in rows] == [
        ("Current Electricity", 2, [2019, 2020], {"2": 1, "5": 1}, "current-electricity"),
        ("Atoms", 2, [0, 2019], {"1": 1, "2": 1}, "atoms"),
    ]
    assert summary.stats(few).first().years == "2019–2020"


def test_progress(spark, few):
    done = spark.createDataFrame([("a-1",), ("stale",)], "id string")
    chapters = spark.createDataFrame([("Atoms",), ("Empty",)], "name string")
    got = {r.name: (r.solved, r.total, r.pct, r.band) for r in state.chapter_progress(chapters, few, done).collect()}
    assert got == {"Atoms": (1, 2, 50, "amber"), "Empty": (0, 0, 0, "gray")}
    assert state.overall_progress(few, done).first().pct == 50


def test_toggle_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    keys = ["user_id", "event_type"]
    source = str(tmp_path / "events")
    events.repartition(3).write.parquet(source)
    stream = toggles.toggled_stream(toggles.toggle_stream(spark, source, events.schema), keys)
    want = {tuple(r) for r in state.toggled(events, keys).collect()}
    stream = toggles.toggled_stream(toggles.toggle_stream(spark, source, events.schema, files=1), keys)
    q = toggles.to_table(stream, str(tmp_path / "t"), str(tmp_path / "c2"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).select("batch").distinct().count() == 3
    assert {tuple(r) for r in toggles.current_from_table(spark, str(tmp_path / "t"), keys).collect()} == want
    toggles.compact(spark, str(tmp_path / "t"), keys)
    assert spark.read.parquet(str(tmp_path / "t")).select("batch").distinct().count() == 2
    assert {tuple(r) for r in toggles.current_from_table(spark, str(tmp_path / "t"), keys).collect()} == want


def test_bank_round_trip(spark, few, tmp_path):
    full = few.withColumns({"bookmarked": F.lit(False), "solved": F.lit(False), "in_syllabus": F.lit(True), "removed_reason": F.lit(None).cast("string")})
    chapters = summary.chapter_summary(few).withColumn("ord", F.col("first").cast("int")).withColumn("count_total", F.lit(None).cast("long"))
    chapters = chapters.select("ord", "name", "count", "count_total", "years", "marks_dist", "slug")
    path = str(tmp_path / "bank")
    bank.write_bank(full, chapters, path)
    q, c = bank.read_bank(spark, path)
    assert sorted(map(tuple, q.select(*few.columns).collect())) == sorted(map(tuple, few.collect()))
    assert {r.name: r.marks_dist for r in c.collect()} == {r.name: r.marks_dist for r in chapters.collect()}
    assert tuple(bank.bank_totals(spark, path).first()) == (4, 1)
    # The folder's files in name order are one JSON document.
    parts = sorted(f for f in glob.glob(f"{path}/*/part-*"))
    root = json.loads("".join(open(f, encoding="utf-8").read() for f in parts))
    assert [r["id"] for r in root["questions"]] == [r.id for r in few.orderBy("ord").collect()] and root["total"] == 4 and root["matched_answers"] == 1
    assert [r["name"] for r in root["chapters"]] == [r.name for r in chapters.orderBy("ord").collect()]
    one = str(tmp_path / "one.json")
    open(one, "w").write(json.dumps(root, indent=2))
    assert {r.id for r in bank.read_bank(spark, one)[0].collect()} == {r["id"] for r in root["questions"]}
    bank.write_bank(full.limit(0), chapters.limit(0), path + "-empty")
    assert [x.count() for x in bank.read_bank(spark, path + "-empty")] == [0, 0]
    bank.write_bank_lines(full, chapters, path + "-lines")
    q, c = bank.read_bank_lines(spark, path + "-lines")
    assert sorted(map(tuple, q.select(*few.columns).collect())) == sorted(map(tuple, few.collect()))
    assert {r.name: r.marks_dist for r in c.collect()} == {r.name: r.marks_dist for r in chapters.collect()}
    assert bank.preferred(spark, str(tmp_path / "none"), path) == path


def test_state_tables(spark):
    table = spark.createDataFrame([("solved", '["b", "a", "a"]'), ("bad", "{")], "key string, value string")
    assert {r.id for r in bank.stored_set(table, "solved").collect()} == {"a", "b"}
    assert bank.stored_set(table, "bad").count() == bank.stored_set(table, "none").count() == 0
    assert bank.set_value(bank.stored_set(table, "solved")).first().value == '["a","b"]'


def test_numbered_and_batches(spark):
    df = bank.numbered(spark.range(100).select((F.col("id") * 7 % 101).alias("v")), F.col("v"))
    rows = sorted(map(tuple, df.select("v", "ord").collect()))
    assert [o for _, o in rows] == list(range(100))
    assert generation.batches(df, "ord").where("batch = 12").count() == 4
    grouped = spark.range(90).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.lit("x").alias("ord"), F.lit("y").alias("at"))
    got = {}
    for r in generation.batches(grouped, "id", group="g").collect():
        got.setdefault((r.g, r.batch), []).append(r.id)
        assert (r.ord, r["at"]) == ("x", "y")
    assert {k: len(v) for k, v in got.items()} == {(g, b): 8 if b < 3 else 6 for g in (None, 1, 2) for b in range(4)}


def test_reply(spark):
    texts = ['```json\n[{"id":"a","answer":"x"}]\n```', "not json"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "batch long, text string")
    assert [(r.id, r.answer) for r in generation.reply_answers(df).collect()] == [("a", "x")]


def test_build(spark):
    pages = spark.createDataFrame([("class-12-physics-atoms-x.pdf", 1, CHAPTER_TEXT)], "file string, page_no int, text string")
    papers = spark.createDataFrame([("Solved Paper 2020.pdf", 1, "1. Define capacitance fully\nAns. V0 √ 2")], "file string, page_no int, text string")
    listed = spark.createDataFrame([("Solved Paper 2020.pdf", 2020)], "file string, year int")
    assert {r.id: r.answer for r in extract(pages, papers, listed).collect()} == {"atoms-1": None, "atoms-2": "V0 √ 2", "atoms-3": None}
    bank_rows, chapters = build(pages, papers, listed)
    assert {r.id: r.answer for r in bank_rows.collect()}["atoms-2"] == r"$\frac{V_0}{\sqrt{2}}$"
    assert chapters.first()["count"] == 3


def test_bank_object(spark, few, tmp_path):
    b = ItemBank.of(few)
    assert [r.slug for r in b.all_chapters().collect()] == ["current-electricity", "atoms"]
    assert [r.id for r in b.chapter_page("atoms", year="2019").collect()] == ["a-1"]
    assert b.chapter_page("unknown").count() == 0 and b.chapter_page("atoms").count() == 2
    assert b.question("c-2").first().marks == 5 and b.total().first().total == 4
    assert [r.year for r in b.years().collect()] == [2020, 2019]
    marked = spark.createDataFrame([("c-1",), ("a-1",), ("gone",)], "id string")
    assert [r.id for r in b.bookmarked(marked).collect()] == ["a-1", "c-1"]
    assert {r.name: r.solved for r in b.progress(marked).collect()} == {"Current Electricity": 1, "Atoms": 1}
    b.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM questions JOIN chapters ON chapter = name").first().n == 4


def rows_read(df):
    """Rows that the Parquet scans of df passed on, after it ran."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.length()))


@pytest.fixture
def plain_plans(spark):
    """Plans whose scans can be asked for their figures after they ran."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    """40,000 items, of which one holds a word that no other does."""
    text = F.when(F.col("id") == 31_234, "The Zyzzyva $5 (rare)").when(F.col("id") % 1000 == 7, F.lit("Émile's OHM  law")).otherwise(F.concat(F.lit("an item about flux number "), "id"))
    rows = spark.range(0, 80_000, 2, 8).select((F.col("id") / 2).cast("long").alias("id")).select(F.col("id").alias("ord"), F.lit("c").alias("chapter"), text.alias("question"), F.lit(2020).alias("year"), F.lit(1).alias("marks"))
    rows = rows.where("id % 5 <> 3 or id = 31234 or id > 39000")
    return stored.StoredItems.build(rows, str(tmp_path_factory.mktemp("shelf") / "items")), rows.cache()


@pytest.mark.parametrize("needle", ["zyzzyva", " ZYZZYVA $5 ", "émile's ohm  l", "ohm  law", "flux", "x n", "ab", "", "nowhere", "number 123"])
def test_stored_search_is_the_plain_search(shelf, monkeypatch, needle):
    table, rows = shelf
    for limit in (1000, 3):
        monkeypatch.setattr(stored, "MAX_BLOCKS", limit)
        for kind in ("search", "chapter_page"):
            got = getattr(table, kind)(chapter="c", text=needle, number=3).collect()
            assert got == getattr(search, kind)(rows, chapter="c", text=needle, number=3).collect()


def test_stored_search_reads_few_rows(shelf, plain_plans):
    table, rows = shelf
    found = table.search(text="zyzzyva")
    assert [r.ord for r in found.collect()] == [31_234]
    assert 0 < rows_read(found) <= 4 * stored.BLOCK_ROWS < rows.count() / 20


def test_stored_pages_by_seeking(shelf, plain_plans):
    table, rows = shelf
    want = [r.ord for r in rows.orderBy("ord").collect()]
    for at in (0, 1, 1000, 31_000, len(want) - 20, len(want)):
        page = table.after(want[at - 1] if at else None, 50)
        assert [r.ord for r in page.collect()] == want[at : at + 50]
        assert rows_read(page) <= 4 * stored.BLOCK_ROWS
    assert [r.ord for r in table.after(12, 700).collect()] == [k for k in want if k > 12][:700]


def test_many_rules_without_a_chapter(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(100_000)]
    words[5:9] = ["é", "", "ab\ncd", "日本"]
    table = spark.createDataFrame([(k, None if k % 3 else ("x", "y")[k % 2], 0, w if k != 6 else None, f"L{k}") for k, w in enumerate(words)], "rule_ord int, chapter string, kw_ord int, keyword string, label string")
    texts = ["".join(rng.choice("abcdefghij \n") for _ in range(rng.randrange(60))) for _ in range(60)] + ["É", "ABCDEFGH", None, "", "日本語", "xyz"]
    rows = [(k % 50, rng.choice(["x", "y", None]), t) for k, t in enumerate(texts)]
    few = spark.createDataFrame(rows, "id int, chapter string, question string")
    got = rules.tag_by_table(few, table)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()

    def label(c, t):
        return next((f"L{k}" for k, w in enumerate(words) if k != 6 and (k % 3 or c == ("x", "y")[k % 2]) and w in t.lower()), None) if t is not None else None

    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, label(c, t))) for i, c, t in rows)


def test_large_bank_document(spark, tmp_path):
    rows = spark.range(0, 200_000, 1, 8).select(
        F.col("id").alias("ord"), F.concat(F.lit("q"), "id").alias("id"), F.lit("Atoms").alias("chapter"), F.lit(1).alias("marks"), F.lit(2020).alias("year"), F.lit('a "quoted"\nquestion').alias("question"),
        F.when(F.col("id") % 2 == 0, "x").alias("answer"), F.lit(False).alias("bookmarked"), F.lit(False).alias("solved"), F.lit(True).alias("in_syllabus"), F.lit(None).cast("string").alias("removed_reason"),
    )
    chapters = spark.createDataFrame([(0, "Atoms", 200_000, None, [2020], {"1": 200_000}, "atoms")], "ord int, name string, count long, count_total long, years array<int>, marks_dist map<string,long>, slug string")
    bank.write_bank(rows, chapters, str(tmp_path / "b"))
    q, c = bank.read_bank(spark, str(tmp_path / "b"))
    assert q.count() == 200_000 and q.exceptAll(rows).count() == 0 and c.first().marks_dist == {"1": 200_000}
    assert len(glob.glob(str(tmp_path / "b" / bank.QUESTIONS / "part-*"))) > 1
    assert tuple(bank.bank_totals(spark, str(tmp_path / "b")).first()) == (200_000, 100_000)


def test_stored_sets_survive_a_failed_write(spark, tmp_path):
    sets = bank.StoredSets(spark, str(tmp_path / "sets"))
    assert sets.read("solved").count() == 0
    sets.write("solved", spark.createDataFrame([("a",), ("b",), ("a",)], "id string"))
    failing = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 900, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("stop"))).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sets.write("solved", failing)
    assert sorted(r.id for r in sets.read("solved").collect()) == ["a", "b"]
    sets.write("solved", spark.range(5000).select(F.col("id").cast("string").alias("id")))
    sets.clean("solved")
    assert sets.read("solved").count() == 5000 and len(glob.glob(str(tmp_path / "sets/solved/set-*"))) == 1


def test_deltas_are_a_recompute(spark, tmp_path):
    rng = random.Random(8)

    def item(k):
        return (k, f"i{k}", rng.choice(["A", "B", "C"]), rng.choice([1, 2, 5, None]), rng.choice([0, 2019, 2020, 2021]), "q", rng.choice(["", None, "x"]), rng.choice([True, True, False, None]))

    schema = "ord long, id string, chapter string, marks int, year int, question string, answer string, in_syllabus boolean"
    now = {k: item(k) for k in range(60)}
    kept = deltas.KeptSummary.start(spark.createDataFrame(list(now.values()), schema), str(tmp_path / "s"))
    for number in range(1, 6):
        old, new = [], []
        for k in rng.sample(range(90), 20):
            old += [now.pop(k)] if k in now else []
            if rng.random() < 0.7:
                now[k] = item(k)
                new.append(now[k])
        kept.add(number, deltas.changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)))
        if number == 3:
            kept.compact(2)
    rows = spark.createDataFrame(list(now.values()), schema).where("coalesce(in_syllabus, true)")
    want = summary.group_summary(rows, "chapter", "year", "marks", "ord").drop("first")
    assert sorted(map(repr, kept.chapters().select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert kept.stats().collect() == summary.stats(rows).collect()
    assert kept.years().collect() == summary.facet(rows, "year").collect()
    assert "batch=1" not in str(spark.read.parquet(str(tmp_path / "s")).inputFiles())


def test_figures_of_the_pass_that_writes(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("$"), F.col("id").cast("string")).alias("x"))
    found = summary.written_with_figures(rows, str(tmp_path / "w"), F.count("*").alias("n"), F.count_if(F.col("id") % 3 == 0).alias("thirds"))
    assert found == {"n": 100, "thirds": 34} and spark.read.parquet(str(tmp_path / "w")).count() == 100


def test_markup_neighbourhoods_are_the_whole_pass(spark):
    rng = random.Random(4)
    atoms = [*"αβπω√×°−∑→5091 2V0XLCmRIUHe^{}_\\.,()-\n\té", *mk.ELEMENTS[:20], "XL", "VC", "V0", "Vm", "i0", "L1", "abc", "the ", "LC ", "\\pi", "\\times", "\\frac{a}{b}", "10", "10-19", "235 92 U", "√ LC", "× 108", "π 3", "  ", "__SQRT__", *"     "]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(30))) for _ in range(3000)] + [" ".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += [t.replace("a", "$", 1).replace("e", "$") for t in texts[:2000]] + ["", None, "plain words only"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    both = df.select("x", mk.markup(F.col("x")).alias("spans"), mk.markup_whole(tx.control_clean(F.col("x"))).alias("whole"))
    assert both.where(~F.col("spans").eqNullSafe(F.col("whole"))).collect() == []


def test_cold_words_are_passed_by_up_to_the_next_neighbourhood(spark):
    rng = random.Random(8)
    atoms = [*"Im XL VC-a aXL a-Im the of 5 x2 √ α $ {b} \n \t é é-VL Vm. it; (Em) EmX".split(" "), " ", "  "]
    texts = [rng.choice(["", " "]).join(rng.choice(["", " ", "-"]) + rng.choice(atoms) for _ in range(rng.randrange(25))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", " ", "word " * 20000]], "x string")
    alone = F.regexp_extract_all("x", F.lit(mk.NEIGHBOURHOOD), F.lit(0))
    cut = F.split(tx.map_spans(F.col("x"), mk.NEIGHBOURHOOD, lambda s: F.when(s == "", s).otherwise(F.concat(F.lit("\x02"), s, F.lit("\x03"))), mk.COLD), "[\x02\x03]", -1)
    assert df.where(~F.filter(cut, lambda _, k: k % 2 == 1).eqNullSafe(alone)).collect() == []


def test_toggle_states_survive_a_restart(spark, tmp_path):
    keys = ["user", "kind"]
    events = spark.range(2000).select((F.col("id") * 7 % 60).alias("user"), (F.col("id") * 13 % 5).cast("string").alias("kind")).where("user % 7 <> 3 or kind <> '2'")
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for part in (events.where("user < 40").limit(700), events.where("user > 20")):
        part.repartition(2).write.mode("append").parquet(source)
        # A new query each time: it goes on from the states of the one before.
        toggle_state.run(toggles.toggle_stream(spark, source, events.schema, files=1), keys, out, marks)
        want = sorted(map(tuple, state.toggled(spark.read.parquet(source), keys).collect()))
        assert sorted(map(tuple, toggle_state.states(spark, marks, keys).collect())) == want
    changes = spark.read.parquet(out)
    last = changes.groupBy(*keys).agg(F.max_by("on", "batch").alias("on")).where("on").select(*keys)
    assert sorted(map(tuple, last.collect())) == want
    # Users below 21 had no events in the second half, so no batch of it wrote them.
    assert changes.where("batch >= 2 and user < 21").count() == 0


def test_pairs_of_toggles_cancel_out_before_the_store(monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice([*range(30), None]), rng.choice(["a", "b", None])) for _ in range(5000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + 300])], names=["user", "n"]) for at in range(0, 5000, 300)]
    for held in (1 << 20, 1000):
        monkeypatch.setattr(toggle_state, "HELD_ROWS", held)
        got = Counter((r["user"], r["n"]) for b in toggle_state.odd(iter(batches)) for r in b.to_pylist())
        assert got == {k: 1 for k, n in Counter(rows).items() if n % 2}
    assert list(toggle_state.odd(iter([]))) == []
