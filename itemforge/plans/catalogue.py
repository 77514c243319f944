"""Registered queries over the driver's tables, each with its SQL counterpart where there is one.

documents stand for items (lang for chapter, text for question), labels.quality for answers, orders
for years and marks, events for toggles, conversations for line blocks. Queries of texts whose
patterns the tables don't hold are in catalogue_texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.functions import labels as lab
from itemforge.functions import text as tx
from itemforge.operators import deltas, generation, match, rules, scan, search, state, stored, summary
from itemforge.plans.bank import ItemBank
from itemforge.scratch import scratch_path
from itemforge.sources.bank import text_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """documents in the shape of questions."""
    d = t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("chapter"), F.col("text").alias("question"), "source", "n_chars")


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    marks = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("chapter"), F.year("o_orderdate").alias("year"), marks.alias("marks"))


def answered(spark: SparkSession, sf: str) -> DataFrame:
    """Items with the label's quality as their answer."""
    lb = t(spark, sf, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").cast("string").alias("answer"))
    return items(spark, sf).join(lb, "ord", "left")


@query("SELECT doc_id AS ord, lang AS chapter, n_chars FROM documents WHERE lang = 'en' AND contains(lower(text), 'license') ORDER BY doc_id LIMIT 30")
def search_page(spark, sf):
    found = search.matching(items(spark, sf), chapter="en", text=" License ")
    return search.page(found, 2, search.SEARCH_PAGE).select("ord", "chapter", "n_chars")


@query("SELECT lang AS chapter, count(*) AS asked, CAST(0 AS BIGINT) AS unasked FROM documents WHERE contains(lower(text), 'license') GROUP BY lang")
def search_without_criteria(spark, sf):
    """A search without criteria finds nothing, beside what the same search finds with one."""
    q, n = items(spark, sf), F.count("*")
    rows = search.matching(q, text="license").select("chapter", F.lit(1).alias("asked")).union(search.matching(q).select("chapter", F.lit(0)))
    return rows.groupBy("chapter").agg(F.sum("asked").alias("asked"), (n - F.sum("asked")).alias("unasked"))


STORED_SQL = "SELECT doc_id AS ord, lang AS chapter FROM documents WHERE {0} ORDER BY doc_id LIMIT {1}"


def shelf(spark, sf, searched: bool = True):
    """documents as stored items, written anew."""
    return stored.StoredItems.build(items(spark, sf), scratch_path(spark, "shelf"), searched)


@query(STORED_SQL.format("lang = 'en' AND contains(lower(text), 'license')", 30))
def stored_search(spark, sf):
    """A search that reads the blocks that hold the needle's trigrams."""
    return shelf(spark, sf).search(chapter="en", text=" License ", number=2).select("ord", "chapter")


@query(STORED_SQL.format("lang = 'en' AND contains(lower(text), ' the ')", 40))
def stored_chapter_search(spark, sf):
    """The same within a chapter, where the needle keeps its blanks."""
    return shelf(spark, sf).chapter_page("en", text=" The ", number=2).select("ord", "chapter")


@query(STORED_SQL.format("doc_id > 150", 20))
def stored_page(spark, sf):
    """The page behind a known item, by seeking."""
    return shelf(spark, sf, searched=False).after(150, 20).select("ord", "chapter")


CHANGED_SQL = (
    "WITH q AS (SELECT o_orderkey AS k, o_orderstatus AS name, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE year(o_orderdate) END AS y, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 9 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS m FROM orders WHERE o_orderkey % 7 <> 0) "
)


def kept_summary(spark, sf):
    """Counts of orders, of which then a seventh is deleted, and in another batch others change year or marks."""
    rows = order_items(spark, sf).withColumn("answer", F.when(F.col("marks") == 1, "x"))
    kept = deltas.KeptSummary.start(rows, scratch_path(spark, "summary"))
    kept.add(1, deltas.changes(rows.where("ord % 7 = 0"), rows.limit(0)))
    old = rows.where("ord % 7 <> 0 and (ord % 11 = 0 or ord % 5 = 0)")
    new = old.withColumns({"year": F.expr("if(ord % 11 = 0, 0, year)"), "marks": F.expr("if(ord % 5 = 0, 9, marks)"), "answer": F.expr("if(ord % 5 = 0, null, answer)")})
    kept.add(2, deltas.changes(old, new))
    return kept


@query(
    CHANGED_SQL + ", d AS (SELECT name, string_agg(m || '=' || c, ',' ORDER BY m) AS marks_dist FROM (SELECT name, m, count(*) AS c FROM q GROUP BY ALL) GROUP BY name), "
    "y AS (SELECT name, count(*) AS count, string_agg(DISTINCT CAST(y AS VARCHAR), ',' ORDER BY CAST(y AS VARCHAR)) AS years FROM q GROUP BY name) SELECT name, count, years, marks_dist FROM y JOIN d USING (name)"
)
def summary_by_deltas(spark, sf):
    s = kept_summary(spark, sf).chapters()
    pairs = F.transform(F.map_entries("marks_dist"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return s.select("name", "count", F.array_join(F.array_sort(F.col("years").cast("array<string>")), ",").alias("years"), F.array_join(F.array_sort(pairs), ",").alias("marks_dist"))


@query(CHANGED_SQL + "SELECT count(*) AS total, count(DISTINCT name) AS chapters, count(*) FILTER (m = 1) AS matched_answers, min(y) FILTER (y <> 0) || '–' || max(y) AS years FROM q")
def stats_by_deltas(spark, sf):
    return kept_summary(spark, sf).stats()


@query(CHANGED_SQL + "SELECT DISTINCT y AS year FROM q WHERE y <> 0")
def facet_by_deltas(spark, sf):
    return kept_summary(spark, sf).years()


@query("SELECT doc_id AS ord FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20")
def chapter_first_page(spark, sf):
    return search.chapter_page(items(spark, sf), "fr").select("ord")


@query("SELECT o_orderkey AS ord FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1996 AND CAST(substr(o_orderpriority, 1, 1) AS INT) = 2")
def year_and_marks_filter(spark, sf):
    return search.matching(order_items(spark, sf).withColumn("question", F.lit("")), chapter="F", year="1996", marks="2").select("ord")


@query("SELECT count(*) AS n, greatest(count(*) - 30, 0) AS remaining FROM documents WHERE contains(lower(text), 'license')")
def result_counts(spark, sf):
    return search.remaining(search.matching(items(spark, sf), text="license"), 2, search.SEARCH_PAGE)


@query("SELECT doc_id AS ord, lang AS chapter FROM documents WHERE source = 'src7' ORDER BY doc_id LIMIT 1")
def lookup(spark, sf):
    return search.lookup(items(spark, sf), "source", "src7").select("ord", "chapter")


@query("SELECT doc_id AS ord, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM (SELECT doc_id FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 15)")
def display_index(spark, sf):
    return search.display_index(search.search(items(spark, sf), chapter="es")).select("ord", F.col("index").cast("long").alias("index"))


@query("SELECT doc_id AS ord FROM documents WHERE contains(text, '$') ORDER BY doc_id LIMIT 5")
def sample_head(spark, sf):
    return search.sample_head(items(spark, sf), F.contains("question", F.lit("$")), 5).select("ord")


@query("SELECT DISTINCT year(o_orderdate) AS year FROM orders ORDER BY year DESC")
def facet_years(spark, sf):
    return summary.facet(order_items(spark, sf), "year")


@query(
    "WITH q AS (SELECT o_orderstatus AS name, year(o_orderdate) AS y, substr(o_orderpriority, 1, 1) AS m, o_orderkey AS k FROM orders), "
    "d AS (SELECT name, string_agg(m || '=' || c, ',' ORDER BY m) AS marks_dist FROM (SELECT name, m, count(*) AS c FROM q GROUP BY ALL) GROUP BY name) "
    "SELECT q.name, count(*) AS count, (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM (SELECT DISTINCT y FROM q q2 WHERE q2.name = q.name)) AS years, "
    "any_value(d.marks_dist) AS marks_dist FROM q JOIN d ON q.name = d.name GROUP BY q.name"
)
def group_summary(spark, sf):
    s = summary.group_summary(order_items(spark, sf), "chapter", "year", "marks", "ord")
    pairs = F.transform(F.map_entries("marks_dist"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return s.select("name", "count", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.array_join(F.array_sort(pairs), ",").alias("marks_dist"))


@query("SELECT o_orderstatus AS chapter, substr(o_orderpriority, 1, 1) AS marks, count(*) AS n FROM orders GROUP BY ALL")
def marks_histogram(spark, sf):
    s = summary.group_summary(order_items(spark, sf), "chapter", "year", "marks", "ord")
    return s.select(F.col("name").alias("chapter"), F.explode("marks_dist").alias("marks", "n"))


@query(
    "SELECT count(*) AS total, count(DISTINCT o_orderstatus) AS chapters, count(*) FILTER (o_orderpriority LIKE '1%') AS matched_answers, "
    "min(year(o_orderdate)) || '–' || max(year(o_orderdate)) AS years FROM orders"
)
def stats_card(spark, sf):
    return summary.stats(order_items(spark, sf).withColumn("answer", F.when(F.col("marks") == 1, "x")))


@query("SELECT o_orderstatus AS name, min(year(o_orderdate)) || '–' || max(year(o_orderdate)) AS years FROM orders GROUP BY 1")
def chapter_year_ranges(spark, sf):
    return summary.chapter_years(summary.group_summary(order_items(spark, sf), "chapter", "year", "marks", "ord"))


@query("SELECT count(*) AS total FROM orders")
def sum_of_counts(spark, sf):
    s = summary.group_summary(order_items(spark, sf), "chapter", "year", "marks", "ord")
    return summary.total_count(s).select(F.col("total").cast("long").alias("total"))


KEY_SQL = "substr(trim(regexp_replace(regexp_replace({0}, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 1, 80)".format("lower(text)")


@query(f"SELECT doc_id AS ord, {KEY_SQL} AS key FROM documents")
def normalize_key(spark, sf):
    return items(spark, sf).select("ord", tx.match_key(F.col("question")).alias("key"))


@query(
    f"WITH d AS (SELECT doc_id, lang, {KEY_SQL} AS key FROM documents), "
    "s AS (SELECT lang, key, arg_max(quality, d.doc_id) AS answer FROM d JOIN labels USING (doc_id) GROUP BY ALL) "
    "SELECT d.doc_id AS ord, CAST(s.answer AS VARCHAR) AS answer FROM d LEFT JOIN s ON d.lang = s.lang AND d.key = s.key"
)
def answer_match(spark, sf):
    asked = items(spark, sf).select("ord", F.col("chapter").alias("year"), "question", F.lit(None).cast("string").alias("answer"))
    lb = t(spark, sf, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").cast("string").alias("found"))
    solved = asked.drop("answer").join(lb, "ord").select("year", "question", F.col("found").alias("answer"), F.lit("one").alias("file"), F.col("ord").alias("pair_ord"))
    return match.match_answers(asked, solved).select("ord", "answer")


@query("SELECT d.doc_id AS ord, CASE WHEN l.toxic = 1 THEN 'new' ELSE CAST(l.quality AS VARCHAR) END AS answer FROM documents d LEFT JOIN labels l USING (doc_id)")
def answer_upsert(spark, sf):
    new = t(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.lit("new").alias("answer"))
    return match.upsert_answers(answered(spark, sf), new).select("ord", "answer")


TAG_RULES = [("en", ["license", "licence"], "License"), ("fr", ["que"], "Que"), (None, ["@mail"], "Mail")]
TAG_SQL = (
    "CASE WHEN lang = 'en' AND (contains(lower(text), 'license') OR contains(lower(text), 'licence')) THEN 'License' "
    "WHEN lang = 'fr' AND contains(lower(text), 'que') THEN 'Que' WHEN contains(lower(text), '@mail') THEN 'Mail' END"
)


@query(f"SELECT doc_id AS ord, {TAG_SQL} AS removed_reason, {TAG_SQL} IS NULL AS in_syllabus FROM documents")
def rule_tag(spark, sf):
    return rules.tag(items(spark, sf), TAG_RULES).select("ord", "removed_reason", "in_syllabus")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, {TAG_SQL} AS removed_reason FROM documents")
def rule_tag_by_table(spark, sf):
    return rules.tag_by_table(items(spark, sf), rules.rule_table(spark, TAG_RULES))


@query(f"SELECT {TAG_SQL} AS removed_reason, count(*) AS n FROM documents WHERE {TAG_SQL} IS NOT NULL GROUP BY 1")
def reason_counts(spark, sf):
    return rules.reason_counts(rules.tag(items(spark, sf), TAG_RULES)).select("removed_reason", "n")


@query("SELECT lang AS name, count(*) AS count_total, count(*) FILTER (%s IS NULL) AS count FROM documents GROUP BY 1" % TAG_SQL)
def tag_recount(spark, sf):
    tagged = rules.tag(items(spark, sf), TAG_RULES)
    chapters = tagged.groupBy(F.col("chapter").alias("name")).agg(F.count("*").alias("count"))
    return rules.recount(chapters, tagged).select("name", "count_total", "count")


@query("SELECT d.lang AS name, coalesce(n, 0) AS count FROM (SELECT DISTINCT lang FROM documents) d LEFT JOIN (SELECT lang, count(*) AS n FROM documents WHERE %s IS NULL GROUP BY 1) k ON d.lang = k.lang" % TAG_SQL)
def delete_recount(spark, sf):
    tagged = rules.tag(items(spark, sf), TAG_RULES)
    chapters = tagged.groupBy(F.col("chapter").alias("name")).agg(F.count("*").alias("count"))
    return rules.recount_after_delete(chapters, tagged)


@query("SELECT d.doc_id AS ord FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL AND n_chars > 500")
def missing_answers(spark, sf):
    q = answered(spark, sf).withColumn("in_syllabus", F.when(F.col("n_chars") <= 500, False))
    return rules.missing_answers(q).select("ord")


@query("SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def toggle_state(spark, sf):
    return state.toggled(t(spark, sf, "events"), ["user_id", "event_type"])


@query(
    "SELECT lang AS name, count(*) FILTER (l.doc_id IS NOT NULL) AS solved, count(*) AS total, "
    "CAST(round(count(*) FILTER (l.doc_id IS NOT NULL)::DOUBLE / count(*) * 100) AS BIGINT) AS pct, "
    "CASE WHEN pct = 100 THEN 'green' WHEN pct > 50 THEN 'blue' WHEN pct > 0 THEN 'amber' ELSE 'gray' END AS band "
    "FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang"
)
def group_progress(spark, sf):
    q = items(spark, sf)
    done = t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return state.chapter_progress(q.select(F.col("chapter").alias("name")).distinct(), q, done)


@query(
    "SELECT (SELECT count(DISTINCT doc_id) FROM labels) AS solved, (SELECT count(*) FROM documents) AS total, "
    "CAST(round((SELECT count(DISTINCT doc_id) FROM labels)::DOUBLE / (SELECT count(*) FROM documents) * 100) AS BIGINT) AS pct"
)
def overall_progress(spark, sf):
    return state.overall_progress(items(spark, sf), t(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id AS ord FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def bookmarks_semi(spark, sf):
    marked = t(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return state.members(items(spark, sf), marked).select("ord")


@query(
    "WITH b AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS blk FROM conversations) "
    "SELECT conv_id, CAST(blk AS BIGINT) AS blk, string_agg(text, chr(10) ORDER BY turn) AS body FROM b WHERE blk > 0 GROUP BY conv_id, blk"
)
def block_scan(spark, sf):
    blocks = scan.running(t(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user", "blk").where("blk > 0")
    return scan.joined_blocks(blocks, ["conv_id", "blk"], "turn", F.col("text"))


@query(
    "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) "
    "OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS asked FROM conversations"
)
def carry_forward(spark, sf):
    asked = F.when(F.col("role") == "user", F.col("turn"))
    return scan.carried(t(spark, sf, "conversations"), "conv_id", "turn", asked, F.lit(-1), "asked").select("conv_id", "turn", "asked")


@query("SELECT doc_id AS ord, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents")
def batching(spark, sf):
    return generation.batches(items(spark, sf), "ord", group="source").select("ord", "batch")


@query("SELECT d.doc_id AS file, CAST(u.n - 1 AS INT) AS n, u.line FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, n)")
def line_explode(spark, sf):
    return text_lines(t(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"))


@query("SELECT doc_id AS ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS question FROM documents")
def collapse_ws(spark, sf):
    return items(spark, sf).select("ord", tx.collapse(F.col("question")).alias("question"))


@query("SELECT doc_id AS ord, coalesce(CAST(nullif(regexp_extract(text, '([0-9]{4})', 1), '') AS INT), 0) AS year FROM documents")
def first_number(spark, sf):
    return items(spark, sf).select("ord", tx.year_or_zero(F.nullif(F.regexp_extract("question", r"(\d{4})", 1), F.lit("")).cast("int")).alias("year"))


@query("SELECT p_partkey, replace(replace(replace(lower(p_name), ' ', '-'), ',', ''), '/', '-') AS slug FROM part")
def slug(spark, sf):
    return t(spark, sf, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@query("SELECT doc_id AS ord, coalesce(length(a) > 0 AND NOT starts_with(a, 'Refer to the official CBSE'), false) AS has_answer FROM (SELECT d.doc_id, CASE WHEN quality = 0 THEN 'Refer to the official CBSE paper' ELSE CAST(quality AS VARCHAR) END AS a FROM documents d LEFT JOIN labels USING (doc_id))")
def has_answer(spark, sf):
    q = answered(spark, sf).withColumn("answer", F.when(F.col("answer") == "0", "Refer to the official CBSE paper").otherwise(F.col("answer")))
    return q.select("ord", lab.has_answer(F.col("answer")).alias("has_answer"))


@query(
    "SELECT o_orderkey AS ord, CASE m WHEN 1 THEN 'blue' WHEN 2 THEN 'green' WHEN 3 THEN 'purple' WHEN 4 THEN 'amber' WHEN 5 THEN 'rose' ELSE 'blue' END AS colour, "
    "CASE m WHEN 1 THEN 'blue' WHEN 2 THEN 'green' WHEN 3 THEN 'purple' WHEN 5 THEN 'rose' ELSE 'amber' END AS accent, "
    "['sky', 'violet', 'emerald', 'orange', 'pink'][y % 5 + 1] AS year_colour, "
    "CASE WHEN m = 5 THEN 'Write each step clearly with formulae. Derive intermediate results and state units.' "
    "WHEN m >= 3 THEN 'Show substitution of values and intermediate steps for full marks.' END AS tip, CASE WHEN m = 1 THEN 'Mark' ELSE 'Marks' END AS unit "
    "FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS m, year(o_orderdate) AS y FROM orders)"
)
def card_labels(spark, sf):
    m = F.col("marks")
    return order_items(spark, sf).select(
        "ord", lab.marks_colour(m).alias("colour"), lab.marks_accent(m).alias("accent"), lab.year_colour(F.col("year")).alias("year_colour"),
        lab.exam_tip(m).alias("tip"), lab.plural(m, "Mark", "Marks").alias("unit"),
    )


@query("SELECT count(*) FILTER (trim(regexp_replace(text, '\\s+', ' ', 'g')) <> text) AS modified FROM documents")
def changed_rows(spark, sf):
    q = items(spark, sf).select("ord", "question")
    return summary.changed_rows(q.withColumn("after", tx.collapse(F.col("question"))), [("question", "after")])


def bank_of(spark: SparkSession, sf: str) -> ItemBank:
    q = items(spark, sf).withColumns({"year": F.lit(0), "marks": (F.col("n_chars") % 5 + 1).cast("int"), "answer": F.lit(None).cast("string")})
    return ItemBank.of(q)


@query("SELECT doc_id AS ord, lang AS chapter FROM documents WHERE lang = 'de' AND n_chars % 5 + 1 = 3 ORDER BY doc_id LIMIT 40")
def bank_chapter_page(spark, sf):
    return bank_of(spark, sf).chapter_page("de", marks="3", page=2).select("ord", "chapter")


@query(
    "SELECT lang AS name, count(*) AS count, '0–0' AS year_range, count(*) FILTER (n_chars % 5 = 0) > 0 AS has_1, count(*) FILTER (n_chars % 5 = 1) > 0 AS has_2, "
    "count(*) FILTER (n_chars % 5 = 2) > 0 AS has_3, count(*) FILTER (n_chars % 5 = 4) > 0 AS has_5 FROM documents GROUP BY 1"
)
def bank_summary(spark, sf):
    return bank_of(spark, sf).summary().select("name", "count", "year_range", "has_1", "has_2", "has_3", "has_5")


@query(
    "SELECT doc_id // 8 AS batch, 'Answer each.' || chr(10) || chr(10) || string_agg('ID: ' || doc_id || chr(10) || 'Chapter: ' || lang || chr(10) || 'Q: ' || text || chr(10), chr(10) ORDER BY doc_id) AS prompt FROM documents GROUP BY 1"
)
def prompt_batches(spark, sf):
    return generation.prompts(generation.batches(items(spark, sf), "ord"), "Answer each.")


@query("SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS id, source AS answer FROM documents")
def reply_parse(spark, sf):
    d = t(spark, sf, "documents")
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("answer")))), F.lit("\n```"))
    rows = generation.reply_answers(d.select(F.col("doc_id").alias("batch"), fenced.alias("text")))
    return rows.select((F.col("ord") / 1_000_000).cast("long").alias("ord"), "id", "answer")
