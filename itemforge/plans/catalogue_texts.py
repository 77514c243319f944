"""Registered queries of scanners, markup, sources and sinks, with their SQL counterparts.

The tables hold few of the patterns that these look for, so each text of documents or conversations
gets a piece that does (SNIPPETS, page heads, answer forms). Texts stay whole and as they are. Word
borders in SQL know ASCII alone, so around a step that has some, its SQL puts an underscore on both
sides of each letter, mark and digit beyond ASCII, and takes them away again (edged).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from itemforge.functions import labels as lab
from itemforge.functions import markup as mk
from itemforge.functions import text as tx
from itemforge.operators import scan, search, state, summary
from itemforge.plans.bank import ItemBank
from itemforge.plans.catalogue import answered, bank_of, items, order_items, query, t
from itemforge.scratch import scratch_path
from itemforge.sources import bank
from itemforge.streaming import toggle_state, toggles

SNIPPETS = [
    "235 92 U and 4 2 He", "1 √ LC", "V0 √ 2 or 2.5 √ 3", "XL VC B0 Im C2", "3 × 108 m/s", "10-19 C", "π 3", "2π 3", "α β", "αβ", "ω0 ω2", "∑", "30°",
    "√ 5 √x √", "10^3 2π", "6.6 × 10^{-34} J", "i0 v0 2,", "$V0$ 2 and $a$ $b$", "$\\sqrt{}$ LC", "3 $\\sqrt$ x", "\\frac{a}{b} \\sin x", "$\\pi$ 4", "$Vm$", "$x$$y$",
    "→E and →", *(f"q {x} r{x}" for x in [*mk.GREEK, *mk.SIGNS]),
]


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


MARKED_SQL = f"SELECT doc_id AS ord, text || ' ' || [{', '.join(map(q, SNIPPETS))}][doc_id % {len(SNIPPETS)} + 1] AS x FROM documents"


def marked(spark, sf):
    """(ord, x): every document's text with one of the snippets."""
    piece = F.get(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % len(SNIPPETS)).cast("int"))
    return t(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat("text", F.lit(" "), piece).alias("x"))


def each(x: str, pattern: str, to: str) -> str:
    """SQL that replaces all matches; <n> stands for group n."""
    to = to.replace("\\", "\\\\")
    for n in range(1, 10):
        to = to.replace(f"<{n}>", f"\\{n}")
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def every(x: str, rules) -> str:
    for pattern, to in rules:
        x = each(x, pattern, to)
    return x


def literal(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


BEYOND = r"([^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{No}])"


def edged(x: str, rules) -> str:
    """The rules, with word borders that know letters beyond ASCII."""
    return each(every(each(x, BEYOND, "_<1>_"), rules), f"_{BEYOND}_", "<1>")


TOKENS = r"regexp_extract_all(x, '\$[^$]+\$|[^$]+|\$')"
IS_MATH = "length(s) > 2 AND starts_with(s, '$')"


def outside(fn) -> str:
    return f"array_to_string(list_transform({TOKENS}, lambda s: CASE WHEN {IS_MATH} THEN s ELSE {fn('s')} END), '')"


def inside(fn) -> str:
    return f"array_to_string(list_transform({TOKENS}, lambda s: CASE WHEN {IS_MATH} THEN {fn('s')} ELSE s END), '')"


NUM, NAME, ROOT = r"(\d+(?:\.\d+)?)", "([A-Za-z][A-Za-z0-9]*)", mk.ROOT
FREE = r"(^|[^A-Za-z_$])"  # in place of a look behind
TO_ROOT = r"$\frac{<1>}{\sqrt{<2>}}$"
STOP, END = r"([\s,)(.\n]|$)", r"([\s,)(.;:]|$)"  # in place of a look ahead
STEPS = {
    "clean": lambda: every("x", [(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), ("  +", " ")]),
    "nuclear": lambda: edged("x", [(r"\b(\d{1,3})\s+(\d{1,2})\s+(" + "|".join(mk.ELEMENTS) + r")\b", r"${}^{<1>}_{<2>}\text{<3>}$")]),
    "symbols": lambda: outside(lambda s: literal(s, [("√", ROOT), *((k, "\\" + v) for k, v in mk.GREEK.items()), *mk.SIGNS.items()])),
    "roots": lambda: outside(lambda s: literal(every(s, [
        (rf"{FREE}{NUM}\s+{ROOT}\s+{NUM}", r"<1>$\frac{<2>}{\sqrt{<3>}}$"), (rf"{FREE}{NUM}\s+{ROOT}\s+{NAME}", r"<1>$\frac{<2>}{\sqrt{<3>}}$"),
        (rf"([A-Za-z][\w\p{{L}}\p{{M}}\p{{Nd}}]*)\s+{ROOT}\s+{NUM}", TO_ROOT), (rf"{ROOT}\s*{NUM}", r"$\sqrt{<1>}$"), (rf"{ROOT}\s*{NAME}", r"$\sqrt{<1>}$"),
    ]), [(ROOT, r"$\sqrt{\cdot}$")])),
    "subscripts": lambda: outside(lambda s: edged(s, [
        (r"\bX([LCR])\b", "$X_{<1>}$"), (r"\bV([LCR])\b", "$V_{<1>}$"), (r"\b([VIEvBbi])0\b", "$<1>_0$"), (r"\b([VIEvi])m\b", "$<1>_m$"),
        (r"\b([CLRilrn])([12345])\b", "$<1>_<2>$"),
    ])),
    "powers": lambda: outside(lambda s: edged(s, [
        (rf"{NUM}\s*\\times\s*10\s*\^?\s*\{{?(-?\d+)\}}?", r"$<1> \times 10^{<2>}$"), (r"\b10-(\d+)\b", "$10^{-<1>}$"),
        (r"10\^?\{?(\d+)\}?\s+(\d*)\\pi", r"$\frac{10^{<1>}}{<2>\pi}$"),
    ])),
    "commands": lambda: outside(lambda s: each(s, r"(\\(?:" + "|".join(mk.COMMANDS) + r")(?:\{[^}]*\})*)", "$<1>$")),
    "denominators": lambda: each("x", r"\$([^$]+)\$ (\d)" + STOP, r"$\frac{<1>}{<2>}$<3>"),
    "pi": lambda: every("x", [
        (r"(\d)\s*\$\\pi\$ (\d+)" + END, r"$\frac{<1>\pi}{<2>}$<3>"), (r"\$\\pi\$ (\d+)" + END, r"$\frac{\pi}{<1>}$<2>"),
        (r"\$([^$]+)\$ \$\\pi\$" + END, r"$\frac{<1>}{\pi}$<2>"), (r"(\d)\$\\frac\{\\pi\}\{(\d+)\}\$", r"$\frac{<1>\pi}{<2>}$"),
    ]),
    "omega": lambda: each("x", r"\$\\omega\$(\d)", r"$\omega^<1>$"),
    "empty_roots": lambda: every("x", [
        (rf"(\d+) \$\\sqrt\{{?\}}?\$\s*{NAME}".replace(r"\{?", r"\{", 1), TO_ROOT), (rf"\$\\sqrt\{{\}}?\$ {NAME}", r"$\sqrt{<1>}$"), (r"\$\\sqrt\{\}\$", r"$\sqrt{\cdot}$"),
    ]),
    "inner": lambda: inside(lambda s: edged(s, [(r"([A-Za-z])0\b", "<1>_0"), (r"([A-Za-z])m\b", "<1>_m")])),
    "fuse": lambda: literal("x", [("$$", ""), ("$ $", " ")]),
}


def steps_sql(*names: str) -> str:
    parts, last = [f"s0 AS ({MARKED_SQL})"], "s0"
    for k, name in enumerate(names, 1):
        parts.append(f"s{k} AS (SELECT ord, {STEPS[name]()} AS x FROM {last})")
        last = f"s{k}"
    return "WITH " + ", ".join(parts) + f" SELECT ord, x FROM {last}"


@query(steps_sql(*STEPS))
def markup_documents(spark, sf):
    """The whole markup pass over every document."""
    return marked(spark, sf).select("ord", mk.markup(F.col("x")).alias("x"))


def _step(name: str, fn, *before: str):
    """A step on its own, after those before it."""
    def run(spark, sf):
        df = marked(spark, sf)
        for f in (*(FUNCTIONS[b] for b in before), fn):
            df = df.select("ord", f(F.col("x")).alias("x"))
        return df

    run.__name__ = f"markup_{name}"
    query(steps_sql(*before, name))(run)


FUNCTIONS = {
    "clean": tx.control_clean, "nuclear": mk.nuclear, "symbols": lambda c: tx.map_segments(c, mk.commands_for_symbols), "roots": lambda c: tx.map_segments(c, mk.roots),
    "subscripts": lambda c: tx.map_segments(c, mk.subscripts), "powers": lambda c: tx.map_segments(c, mk.powers_of_ten),
    "commands": lambda c: tx.map_segments(c, mk.wrap_commands), "denominators": mk.denominators, "pi": mk.pi_fractions, "omega": mk.omega_powers,
    "empty_roots": mk.empty_roots, "inner": mk.inner_subscripts, "fuse": mk.fuse,
}
for _name, _before in {
    "clean": (), "nuclear": (), "symbols": (), "roots": ("symbols",), "subscripts": (), "powers": ("symbols",), "commands": ("symbols",), "denominators": ("commands",),
    "pi": ("symbols", "commands"), "omega": ("symbols", "commands"), "empty_roots": (), "inner": (), "fuse": (),
}.items():
    _step(_name, FUNCTIONS[_name], *_before)


GOLDEN = {
    "235 92 U": r"${}^{235}_{92}\text{U}$", "1 √ LC": r"$\frac{1}{\sqrt{LC}}$", "V0 √ 2": r"$\frac{V_0}{\sqrt{2}}$", "XL": "$X_{L}$",
    "3 × 108 m/s": r"$3 \times 10^{8}$ m/s", "π 3": r"$\frac{\pi}{3}$", "2π 3": r"$\frac{2\pi}{3}$", "α β": r"$\alpha \beta$",
    "αβ": r"$\alpha\beta$", "ω0": r"$\omega^0$", "∑": r"$\su_m$", "30°": r"30^$\circ$", "": "",
}


@query(f"SELECT doc_id AS ord, source || ' ' || [{', '.join(map(q, GOLDEN.values()))}][doc_id % {len(GOLDEN)} + 1] AS text FROM documents")
def markup_rows(spark, sf):
    """Known notations and what they become, each behind a word of the table's rows."""
    d = t(spark, sf, "documents")
    piece = F.get(F.array(*map(F.lit, GOLDEN)), (F.col("doc_id") % len(GOLDEN)).cast("int"))
    return d.select(F.col("doc_id").alias("ord"), mk.markup(F.concat("source", F.lit(" "), piece)).alias("text"))


AUDIT = (
    "SELECT count(*) FILTER ((length(x) - length(replace(x, '$', ''))) % 2 <> 0) AS odd_dollar, count(*) FILTER (contains(x, '$\\sqrt{}$')) AS empty_root, "
    "count(*) FILTER (regexp_matches(x, '\\$\\\\pi\\$ [0-9]')) AS pi_digit, count(*) FILTER (regexp_matches(x, '\\$\\\\omega\\$[0-9]')) AS omega_digit, "
    "count(*) FILTER (regexp_matches(x, '\\$[^$]+\\$ [0-9]([\\s,).]|$)')) AS denominator"
)


@query(f"WITH s AS ({MARKED_SQL}) {AUDIT} FROM s")
def audit_counts(spark, sf):
    return marked(spark, sf).agg(*mk.audit(F.col("x")))


@query(f"WITH t AS ({steps_sql(*STEPS)}) {AUDIT} FROM t")
def audit_of_written(spark, sf):
    """The audit's counts of texts that are marked up and written, taken in the pass that writes them."""
    found = summary.written_with_figures(markup_documents(spark, sf), scratch_path(spark, "marked"), *mk.audit(F.col("x")))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} bigint" for k in found))


LATE = "ω π α β γ Γ δ Δ ε θ λ μ µ ν ξ ρ σ τ φ χ ψ Ω".split()
RESIDUAL_SQL = literal("x", [(c, f"$\\{mk.GREEK[c]}$") for c in LATE])
RESIDUAL_SQL = literal(each(RESIDUAL_SQL, r"\s*°\s*", r"$^{\circ}$"), [(c, f"${mk.SIGNS[c]}$") for c in "×÷"])
RESIDUAL_SQL = literal(each(RESIDUAL_SQL, "→([A-Za-z])", r"$\vec{<1>}$"), [*((c, f"${mk.SIGNS[c]}$") for c in "→≤≥≠≈∝∞"), ("−", "-")])


@query(f"WITH s AS ({MARKED_SQL}) SELECT ord, {RESIDUAL_SQL} AS x FROM s")
def residual_symbols(spark, sf):
    return marked(spark, sf).select("ord", mk.residual_symbols(F.col("x")).alias("x"))


MERGE = r"\$([^$]+)\$\s*\$([^$]+)\$"


@query(f"WITH s AS ({MARKED_SQL}) SELECT ord, {each('x', MERGE, '$<1> <2>$')} AS x FROM s")
def merge_blocks(spark, sf):
    return marked(spark, sf).select("ord", mk.merge_blocks(F.col("x")).alias("x"))


@query(
    f"WITH s AS ({MARKED_SQL}) SELECT ord, array_to_string(regexp_extract_all('$$' || x || '$$', '\\$\\$([^$]+?)\\$\\$', 1), '|') AS display, "
    "array_to_string(regexp_extract_all(x, '\\$([^$\\n]+?)\\$', 1), '|') AS inline, replace(x, chr(10), '<br/>') AS broken FROM s"
)
def display_parts(spark, sf):
    x = F.col("x")
    shown = F.array_join(mk.display_math(F.concat(F.lit("$$"), x, F.lit("$$"))), "|").alias("display")
    return marked(spark, sf).select("ord", shown, F.array_join(mk.inline_math(x), "|").alias("inline"), mk.line_breaks(x).alias("broken"))


@query(f"WITH s AS ({MARKED_SQL}) SELECT ord, array_to_string(list_filter({TOKENS}, lambda s: {IS_MATH}), '|') AS math FROM s")
def math_segments(spark, sf):
    """The math blocks of every text; what lies between is what markup steps change."""
    return marked(spark, sf).select("ord", F.array_join(F.filter(tx.segments(F.col("x")), tx.is_math), "|").alias("math"))


# Scanners, over conversations as pages.

PAGE_SQL = (
    "'Collegedunia | Class 12 Physics ' || chr(10) || 'Chapter ' || turn || chr(10) || CASE role WHEN 'system' THEN '2-Mark Questions' || chr(10) || text "
    "WHEN 'user' THEN CASE WHEN turn % 4 = 3 THEN 'Q' || turn || '.' || chr(10) || '3-Mark Questions' || chr(10) ELSE '' END || 'Q' || turn || '. ' || text || "
    "CASE WHEN turn % 3 = 0 THEN ' [20' || (10 + turn) || ' • Delhi]' WHEN turn % 3 = 1 THEN ' [20' || (10 + turn) || ']' ELSE '' END "
    "ELSE text || chr(10) || chr(10) || chr(10) || '5-mark questions' END || chr(10) || 'Page ' || turn || chr(10)"
)
DOCS_SQL = f"pages AS (SELECT CAST(conv_id AS VARCHAR) AS file, turn AS page_no, {PAGE_SQL} AS text FROM conversations), docs AS (SELECT file, string_agg(text, chr(10) ORDER BY page_no) || chr(10) AS text FROM pages GROUP BY file)"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


CLEAN_SQL = strip_sql(every("text", [(tx.PAGE_HEAD, ""), (tx.PAGE_FOOT, ""), (tx.PAGE_NUMBER, "\n"), (r"\n{3,}", "\n\n")]))


def chapter_pages(spark, sf):
    return t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("page_no"), F.expr(PAGE_SQL.replace("chr(10)", "char(10)")).alias("text"))


@query(f"WITH {DOCS_SQL} SELECT file, text FROM docs")
def document_text(spark, sf):
    return bank.document_text(chapter_pages(spark, sf))


@query(f"WITH {DOCS_SQL} SELECT file, {CLEAN_SQL} AS text FROM docs")
def clean_pages(spark, sf):
    return bank.document_text(chapter_pages(spark, sf)).select("file", tx.clean_pages(F.col("text")).alias("text"))


@query(f"WITH {DOCS_SQL} SELECT file, CAST(n - 1 AS BIGINT) AS n, line FROM (SELECT file, {CLEAN_SQL} AS text FROM docs) d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY u(line, n)")
def clean_lines(spark, sf):
    """Lines of cleaned files, from parts stitched over page borders: no row holds a file."""
    return scan.part_lines(scan.clean_parts(chapter_pages(spark, sf)))


CHAPTER_SQL = "['Atoms', 'Wave Optics', 'Nuclei'][CAST(file AS BIGINT) % 3 + 1]"


def chapter_parts(spark, sf):
    name = F.get(F.array(*map(F.lit, ["Atoms", "Wave Optics", "Nuclei"])), (F.col("file").cast("long") % 3).cast("int"))
    return scan.clean_parts(chapter_pages(spark, sf).withColumn("chapter", name), "chapter")


@query(
    f"""
WITH {DOCS_SQL},
lines AS (SELECT file, n, {strip_sql('line')} AS line FROM (SELECT file, {CLEAN_SQL} AS text FROM docs) d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY u(line, n)),
flags AS (SELECT *, regexp_matches(line, '^Q\\d+\\.') AS brk, TRY_CAST(nullif(regexp_extract(line, '(?i)(\\d+)-Mark Questions', 1), '') AS INT) AS hdr,
  regexp_extract(line, '^Q\\d+\\.\\s+(.*)', 1) AS body0, regexp_matches(line, '^Q\\d+\\.\\s+') AS opened FROM lines),
numbered AS (SELECT *, opened AND hdr IS NULL AS start, sum(CAST(brk AS INT)) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING) AS blk FROM flags),
asked AS (SELECT *, blk > 0 AND first_value(start) OVER (PARTITION BY file, blk ORDER BY n) AS is_q FROM numbered),
valued AS (SELECT *, coalesce(last_value(CASE WHEN NOT is_q THEN hdr END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING), 1) AS marks FROM asked),
blocks AS (SELECT file, blk, arg_min(marks, n) AS marks, {strip_sql("string_agg(CASE WHEN start THEN body0 ELSE line END, chr(10) ORDER BY n)")} AS full_text FROM valued WHERE is_q GROUP BY file, blk),
kept AS (SELECT file, blk, marks, coalesce(CAST(nullif(regexp_extract(full_text, '\\[(\\d{{4}})(?:\\s*[•·][^\\]]+)?\\]', 1), '') AS INT), 0) AS year,
  {strip_sql("regexp_replace(regexp_replace(full_text, '\\[(\\d{4})(?:\\s*[•·][^\\]]+)?\\]', '', 'g'), '\\s+', ' ', 'g')")} AS question, {CHAPTER_SQL} AS chapter FROM blocks)
SELECT file, replace(lower(chapter), ' ', '-') || '-' || row_number() OVER (PARTITION BY chapter ORDER BY file, blk) AS id, chapter, marks, year, question FROM kept WHERE length(question) > 15
"""
)
def chapter_scan(spark, sf):
    return scan.chapter_questions_of(chapter_parts(spark, sf)).select("file", "id", "chapter", "marks", "year", "question")


PAPER_SQL = (
    "CASE role WHEN 'system' THEN '99. ' || text WHEN 'user' THEN CASE WHEN turn % 4 = 1 THEN '  ' ELSE '' END || (turn // 2 + 1) || '. ' || text "
    "ELSE CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Ans. ' END || text || CASE WHEN conv_id % 5 = 0 THEN chr(10) || '8.' ELSE '' END END"
)


@query(
    f"""
WITH RECURSIVE docs AS (SELECT CAST(conv_id AS VARCHAR) AS file, string_agg({PAPER_SQL}, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id),
lines AS (SELECT file, n, line, TRY_CAST(nullif(regexp_extract(line, '^\\s*(\\d+)\\.\\s+(.*)', 1), '') AS BIGINT) AS num, regexp_extract(line, '^\\s*(\\d+)\\.\\s+(.*)', 2) AS rest,
  regexp_matches(line, '^\\s*Ans\\.\\s*') AS ans, regexp_extract(line, '^\\s*Ans\\.\\s*(.*)', 1) AS reply, regexp_matches(line, '^\\s*\\d+\\.(\\s|$)') AS bare
  FROM docs, unnest(string_split(docs.text, chr(10))) WITH ORDINALITY u(line, n)),
st(file, n, num, answering, seq, kind) AS (
  SELECT DISTINCT file, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, 0, 'out' FROM docs
  UNION ALL
  SELECT file, n, CASE WHEN keep THEN was WHEN opens THEN num ELSE 0 END, CASE WHEN keep THEN answering OR ans ELSE false END, CASE WHEN keep OR NOT opens THEN seq ELSE seq + 1 END,
    CASE WHEN keep AND answering THEN 'a' WHEN keep AND ans THEN 'reply' WHEN keep THEN 'q' WHEN opens THEN 'open' ELSE 'out' END
  FROM (SELECT l.file, l.n, l.num, l.ans, s.num AS was, s.answering, s.seq, coalesce(l.num BETWEEN 1 AND 35, false) AS opens,
    s.num > 0 AND CASE WHEN s.answering THEN l.num IS NULL AND NOT l.bare ELSE l.ans OR coalesce(l.num <> s.num + 1, true) END AS keep
    FROM st s JOIN lines l ON l.file = s.file AND l.n = s.n + 1)
),
parts AS (SELECT st.file, st.seq, st.n, st.kind, CASE st.kind WHEN 'open' THEN l.rest WHEN 'reply' THEN l.reply ELSE l.line END AS part, CASE WHEN st.kind = 'open' THEN st.num END AS q_num
  FROM st JOIN lines l ON l.file = st.file AND l.n = st.n WHERE st.kind <> 'out'),
pairs AS (SELECT file, seq, max(q_num) AS q_num,
  {strip_sql("regexp_replace(string_agg(part, ' ' ORDER BY n) FILTER (kind IN ('open', 'q')), '\\s+', ' ', 'g')")} AS question,
  nullif({strip_sql("regexp_replace(string_agg(part, ' ' ORDER BY n) FILTER (kind IN ('reply', 'a')), '\\s+', ' ', 'g')")}, '') AS answer FROM parts GROUP BY file, seq)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS INT) AS pair_ord, CAST(q_num AS INT) AS q_num, question, answer FROM pairs WHERE length(question) > 10
"""
)
def solved_scan(spark, sf):
    c = t(spark, sf, "conversations").withColumn("x", F.expr(PAPER_SQL.replace("chr(10)", "char(10)").replace("turn // 2", "turn div 2")))
    parts = c.select(F.col("conv_id").cast("string").alias("file"), F.lit(2020).alias("year"), F.col("turn").cast("long").alias("part"), F.col("x").alias("text"))
    return scan.solved_pairs_of(parts).select("file", "pair_ord", "q_num", "question", "answer")


ANSWER_SQL = (
    "CASE doc_id % 7 WHEN 0 THEN 'Option (b) is correct. ' || text WHEN 1 THEN '(c) ' || source WHEN 2 THEN text || chr(10) || 'Step 1: ' || source || chr(10) || '2) ' || lang || chr(10) || '(iv) end' "
    "WHEN 3 THEN 'Body text. Note: ' || text WHEN 4 THEN 'Explanation: ' || text WHEN 5 THEN 'option (D)  is correct' ELSE text END"
)
STEP_SPLIT = "\\n(Step\\s*\\d|\\(\\s*[ivxIVXa-z]+\\s*\\)|\\d+[.)]\\s)"
STEP_LABEL = "(?i)^(Step\\s*\\d+[:.)]|\\(\\s*[ivxa-z]+\\s*\\)|\\d+[.)]\\s)"
NONE = "CAST(NULL AS VARCHAR)"


@query(
    f"""
WITH a AS (SELECT doc_id AS ord, {strip_sql(ANSWER_SQL)} AS x FROM documents),
b AS (SELECT *, nullif(upper(regexp_extract(x, '(?i)^Option\\s*\\(([A-D])\\)\\s+is\\s+correct\\.?\\s*', 1)), '') AS opt FROM a),
c AS (SELECT *, CASE WHEN opt IS NULL THEN nullif(upper(regexp_extract(x, '(?i)^\\(([A-D])\\)\\s+(.{{0,120}})\\z', 1)), '') END AS short,
  CASE WHEN opt IS NULL THEN x ELSE {strip_sql("regexp_replace(x, '(?i)^Option\\s*\\(([A-D])\\)\\s+is\\s+correct\\.?\\s*', '')")} END AS y FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(y, '(?i)^Explanation[:\\s]+') THEN {strip_sql("regexp_replace(y, '(?i)^Explanation[:\\s]+', '')")} ELSE y END AS rest FROM c),
e AS (SELECT *, string_split(regexp_replace(rest, '{STEP_SPLIT}', chr(1) || '\\1', 'g'), chr(1)) AS parts, regexp_extract(rest, '(?is)^(.*?)\\bNote\\s*:', 1) AS lead, regexp_matches(rest, '(?i)\\bNote\\s*:') AS noted FROM d),
f AS (SELECT ord, CASE WHEN short IS NOT NULL THEN [{{'type': 'option', 'content': '(' || short || ') ' || regexp_extract(x, '(?i)^\\(([A-D])\\)\\s+(.{{0,120}})\\z', 2), 'label': short}}]
  ELSE list_concat(CASE WHEN opt IS NULL THEN [] ELSE [{{'type': 'option', 'content': 'Option (' || opt || ') is correct', 'label': opt}}] END,
    CASE WHEN len(parts) > 1 THEN list_transform(parts, lambda p: CASE WHEN regexp_extract(p, '{STEP_LABEL}', 1) <> ''
        THEN {{'type': 'step', 'content': {strip_sql(f"substr(p, length(regexp_extract(p, '{STEP_LABEL}', 1)) + 1)")}, 'label': {strip_sql(f"regexp_extract(p, '{STEP_LABEL}', 1)")}}}
        ELSE {{'type': 'plain', 'content': {strip_sql('p')}, 'label': {NONE}}} END)
      WHEN noted AND lead <> '' THEN [{{'type': 'plain', 'content': {strip_sql('lead')}, 'label': {NONE}}},
        {{'type': 'note', 'content': {strip_sql("regexp_replace(substr(rest, length(lead) + 1), '(?i)^Note\\s*:\\s*', '')")}, 'label': {NONE}}}]
      ELSE [{{'type': 'plain', 'content': rest, 'label': {NONE}}}] END) END AS segs FROM e),
g AS (SELECT ord, list_filter(segs, lambda s: {strip_sql('s.content')} <> '') AS segs FROM f)
SELECT ord, CAST(i - 1 AS INT) AS pos, s.type AS type, s.content AS content, s.label AS label FROM g, unnest(g.segs) WITH ORDINALITY u(s, i)
"""
)
def answer_segments(spark, sf):
    rows = t(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.expr(ANSWER_SQL.replace("chr(10)", "char(10)")).alias("answer"))
    return rows.select("ord", F.posexplode(scan.answer_segments(F.col("answer"))).alias("pos", "s")).select("ord", "pos", "s.*")


# Small columns.

KEYS = [key for key, _, _ in lab.CHAPTERS]
STEM_SQL = f"'class-12-physics-' || CASE WHEN p_partkey % 3 = 0 THEN [{', '.join(map(q, KEYS))}][p_partkey % {len(KEYS)} + 1] ELSE replace(p_name, ' ', '-') || '-o''x-3d' END || '-pyq-177970212' || (p_partkey % 9)"
BARE_SQL = literal("stem", [(lab.FILE_PREFIX, ""), *((x, "") for x in lab.FILE_SUFFIXES), ("-", " ")])
NAME_SQL = " ".join(f"WHEN contains(stem, {q(key)}) THEN {q(name)}" for key, name, _ in sorted(lab.CHAPTERS))


@query(
    f"WITH s AS (SELECT p_partkey, {STEM_SQL} AS stem FROM part) SELECT p_partkey, CASE {NAME_SQL} ELSE array_to_string(list_transform(regexp_extract_all({BARE_SQL}, '[A-Za-z]+|[^A-Za-z]+'), "
    "lambda w: upper(w[1]) || lower(w[2:])), '') END AS chapter FROM s"
)
def chapter_of_file(spark, sf):
    key = F.get(F.array(*map(F.lit, KEYS)), (F.col("p_partkey") % len(KEYS)).cast("int"))
    other = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-o'x-3d"))
    stem = F.concat(F.lit("class-12-physics-"), F.when(F.col("p_partkey") % 3 == 0, key).otherwise(other), F.lit("-pyq-177970212"), (F.col("p_partkey") % 9).cast("string"))
    return t(spark, sf, "part").select("p_partkey", lab.chapter_of_file(stem).alias("chapter"))


NAMES = [name for _, name, _ in lab.CHAPTERS] + ["Other"]


@query(
    f"WITH s AS (SELECT p_partkey, [{', '.join(map(q, NAMES))}][p_partkey % {len(NAMES)} + 1] AS name, p_size % 7 AS y FROM part) SELECT p_partkey, y > 0 AS shown, CASE name "
    + " ".join(f"WHEN {q(n)} THEN {q(i)}" for _, n, i in lab.CHAPTERS)
    + f" ELSE {q(lab.DEFAULT_ICON)} END AS icon, [{', '.join(map(q, lab.CHAPTER_COLOURS))}][p_partkey % 14 + 1] AS colour FROM s"
)
def chapter_looks(spark, sf):
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % len(NAMES)).cast("int"))
    rows = t(spark, sf, "part").withColumn("name", name)
    return rows.select("p_partkey", lab.year_shown(F.col("p_size") % 7).alias("shown"), lab.chapter_icon(F.col("name")).alias("icon"), lab.chapter_colour(F.col("p_partkey").cast("int")).alias("colour"))


@query(
    "WITH c AS (SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS shown FROM documents GROUP BY source) "
    "SELECT source, CASE WHEN shown = total THEN total || ' questions' ELSE shown || ' of ' || total || ' questions' END AS label FROM c"
)
def result_labels(spark, sf):
    c = t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("shown"))
    return c.select("source", lab.result_label(F.col("shown"), F.col("total")).alias("label"))


@query("SELECT doc_id AS ord FROM documents WHERE lang = 'en' AND contains(lower(text), ' the ') ORDER BY doc_id LIMIT 40")
def chapter_search_raw(spark, sf):
    """Within a chapter the needle keeps its blanks."""
    return search.chapter_page(items(spark, sf), "en", text=" The ", number=2).select("ord")


ORDER_NAMES = "CASE lang WHEN 'en' THEN 'Nuclei' WHEN 'fr' THEN 'Atoms' WHEN 'de' THEN 'Zoo' ELSE 'Area' END"


@query(
    f"SELECT {ORDER_NAMES} AS name, CASE name WHEN 'Nuclei' THEN 12 WHEN 'Atoms' THEN 11 ELSE 1048576 + min(doc_id) END AS ord, count(*) AS count FROM documents GROUP BY 1"
)
def dimension_order(spark, sf):
    rows = t(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.expr(ORDER_NAMES).alias("chapter"), F.col("text").alias("question"), F.lit(2020).alias("year"), F.lit(1).alias("marks"),
        F.lit(None).cast("string").alias("answer"),
    )
    return ItemBank.of(rows).all_chapters().select("name", "ord", "count")


@query("SELECT doc_id AS ord, lang AS chapter FROM documents")
def all_questions(spark, sf):
    return bank_of(spark, sf).all_questions().select("ord", "chapter")


@query("SELECT lang AS chapter, count(*) AS n FROM documents GROUP BY lang")
def bank_views(spark, sf):
    bank_of(spark, sf).register(spark)
    return spark.sql("SELECT q.chapter, count(*) AS n FROM questions q JOIN chapters c ON q.chapter = c.name GROUP BY q.chapter")


# Sources and sinks.

FILES = sorted(f"{n}.parquet" for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {q(f)})" for k, f in enumerate(FILES)) + ") v(place, file)")
def folder_files(spark, sf):
    """Names of a folder's files, with their place in the order in which they come: one row a file."""
    found = bank.chapter_files(spark, sf, "*.parquet").select("file", F.monotonically_increasing_id().alias("came"))
    return found.select((F.row_number().over(Window.orderBy("came")) - 1).alias("place"), "file")


PAPERS = [*bank.SOLVED_PAPERS, "Other.pdf"]


@query(
    f"WITH f AS (SELECT DISTINCT [{', '.join(map(q, PAPERS))}][doc_id % {len(PAPERS)} + 1] AS file FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 2 = 0) SELECT f.file, p.year FROM f JOIN (VALUES "
    + ", ".join(f"({q(n)}, {y})" for n, y in bank.SOLVED_PAPERS.items())
    + ") p(file, year) ON f.file = p.file"
)
def solved_papers(spark, sf):
    d = t(spark, sf, "documents").where("doc_id % 5 <> 0 or doc_id % 2 = 0")
    return bank.solved_papers(d.select(F.get(F.array(*map(F.lit, PAPERS)), (F.col("doc_id") % len(PAPERS)).cast("int")).alias("file")))


def _stored(df):
    return df.select(
        "ord", "id", "chapter", F.lit(1).alias("marks"), F.lit(2020).alias("year"), "question", "answer", F.lit(False).alias("bookmarked"), F.lit(True).alias("solved"),
        F.lit(True).alias("in_syllabus"), F.lit(None).cast("string").alias("removed_reason"),
    )


def _chapters(df):
    s = summary.chapter_summary(df)
    return s.select(F.coalesce("place", "first").cast("int").alias("ord"), "name", "count", F.lit(None).cast("long").alias("count_total"), "years", "marks_dist", "slug")


@query("SELECT n_nationkey AS ord, 'n' || n_nationkey AS id, r_name AS chapter, n_name AS question, (SELECT count(*) FROM nation) AS total FROM nation JOIN region ON n_regionkey = r_regionkey")
def bank_document(spark, sf):
    """A bank written as one JSON document and read back."""
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("r_name").alias("chapter"), F.col("n_name").alias("question"), F.lit(None).cast("string").alias("answer")
    )
    path = scratch_path(spark, "bank")
    bank.write_bank(_stored(rows), _chapters(_stored(rows)), path)
    read, _ = bank.read_bank(spark, bank.preferred(spark, f"{path}/raw", path))
    total = bank.bank_totals(spark, path).select("total", F.lit(1).alias("marks"))  # one row
    return read.join(total, "marks").select("ord", "id", "chapter", "question", "total")


@query("SELECT d.doc_id AS ord, lang AS chapter, text AS question, CAST(quality AS VARCHAR) AS answer FROM documents d LEFT JOIN labels l USING (doc_id)")
def bank_lines(spark, sf):
    """A bank of any size written as JSON lines and read back."""
    rows, path = _stored(answered(spark, sf)), scratch_path(spark, "bank")
    bank.write_bank_lines(rows, _chapters(rows), path)
    return bank.read_bank_lines(spark, path)[0].select("ord", "chapter", "question", "answer")


@query("SELECT count(*) AS n FROM documents")
def preferred_source(spark, sf):
    """The raw document is read only where there is one."""
    return spark.read.parquet(bank.preferred(spark, f"{sf}/documents_raw.parquet", f"{sf}/documents.parquet")).agg(F.count("*").alias("n"))


VALUE_SQL = "CASE WHEN event_id % 5 = 0 THEN '[\"u' || user_id || '\"' ELSE '[\"u' || user_id || '\", \"v' || (user_id % 3) || '\"]' END"


@query("SELECT DISTINCT unnest(['u' || user_id, 'v' || (user_id % 3)]) AS id FROM events WHERE event_type = 'click' AND event_id % 5 <> 0")
def stored_set(spark, sf):
    """Ids of stored JSON arrays; broken ones are empty."""
    return bank.stored_set(t(spark, sf, "events").select(F.col("event_type").alias("key"), F.expr(VALUE_SQL).alias("value")), "click")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'none' ELSE 'u' || user_id || ',v' || (user_id % 3) END AS ids FROM events")
def stored_value(spark, sf):
    value = bank.stored_value(F.expr(VALUE_SQL), "array<string>", F.array(F.lit("none")))
    return t(spark, sf, "events").select("event_id", F.array_join(value, ",").alias("ids"))


@query("SELECT '[\"' || string_agg(DISTINCT n_name, '\",\"' ORDER BY n_name) || '\"]' AS value FROM nation")
def set_value(spark, sf):
    return bank.set_value(t(spark, sf, "nation").select(F.col("n_name").alias("id")))


@query("SELECT DISTINCT 'u' || user_id AS id FROM events WHERE event_type = 'click'")
def stored_sets(spark, sf):
    """A set of any size, written over a former one under its key and read back."""
    ids = t(spark, sf, "events").select("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"))
    sets = bank.StoredSets(spark, scratch_path(spark, "sets"))
    sets.write("solved", ids)
    sets.write("solved", ids.where("event_type = 'click'"))
    return sets.read("solved")


@query("SELECT doc_id AS ord, lang AS chapter FROM documents")
def appended(spark, sf):
    """Lists of several files put together."""
    d = items(spark, sf).select("ord", "chapter")
    return bank.append(d.where("ord % 3 = 0"), d.where("ord % 3 = 1"), d.where("ord % 3 = 2"))


@query("SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def toggle_stream(spark, sf):
    """Toggles read as a stream, kept as a table of changes that a later session reads."""
    path = t(spark, sf, "events")
    keys = ["user_id", "event_type"]
    source, kept, marks = (scratch_path(spark, n) for n in ("events", "state", "marks"))
    path.select(*keys).repartition(4).write.parquet(source)
    stream = toggles.toggled_stream(toggles.toggle_stream(spark, source, path.select(*keys).schema, files=2), keys)
    toggles.to_table(stream, kept, marks).awaitTermination()
    toggles.compact(spark, kept, keys)
    return toggles.current_from_table(spark, kept, keys)


@query("SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def toggle_store(spark, sf):
    """Toggles kept as states of a stream, read from its state store after it has ended."""
    events, keys = t(spark, sf, "events"), ["user_id", "event_type"]
    source, out, marks = (scratch_path(spark, n) for n in ("events", "changes", "marks"))
    files = spark.sparkContext.defaultParallelism  # of a batch; there are two, so the second meets states
    events.select(*keys).repartition(2 * files).write.parquet(source)
    toggle_state.run(toggles.toggle_stream(spark, source, events.select(*keys).schema, files=files), keys, out, marks)
    return toggle_state.states(spark, marks, keys)


@query("SELECT doc_id AS ord, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE regexp_replace(regexp_replace(text || chr(7) || '  x', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '  +', ' ', 'g') END AS x FROM documents")
def control_clean(spark, sf):
    x = F.when(F.col("ord") % 5 != 0, F.concat("question", F.lit("\x07  x")))
    return items(spark, sf).select("ord", tx.control_clean(x).alias("x"))


@query("SELECT o_orderkey AS ord, year(o_orderdate) AS year FROM orders WHERE year(o_orderdate) % 5 <> 0")
def truthy_years(spark, sf):
    o = order_items(spark, sf)
    zeroed = o.withColumn("year", F.when(F.col("year") % 5 == 0, 0).otherwise(F.col("year")))
    return zeroed.join(summary.facet(zeroed, "year"), "year", "left_semi").select("ord", "year")


@query("SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def solved_members(spark, sf):
    q_ = t(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"))
    return state.members(q_, t(spark, sf, "labels").select(F.col("doc_id").alias("id"))).select("id")
