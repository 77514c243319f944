"""Keyword rules: tagging, selection, deletion and the recounts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.scratch import materialize

# Fixed values: (chapter, keywords, label), tried in this order.
RULES = [
    (
        "Semiconductor Electronics",
        [
            "communication system", "amplitude modulation", "frequency modulation", "sky wave", "space wave", "ground wave", "carrier wave",
            "carrier frequency", "bandwidth", "modulation index", "demodulation", "transmitt", "receiver", "antenna", "transducer",
            "signal-to-noise", "repeater", "electronic communication", "long distance communication", "internet",
            "optical fibre communication", "radar",
        ],
        "Communication Systems",
    ),
    ("Electrostatic Potential and Capacitance", ["van de graaff", "van-de-graaff", "electrostatic generator"], "Van de Graaff Generator"),
    ("Moving Charges and Magnetism", ["cyclotron"], "Cyclotron"),
    ("Dual Nature of Radiation and Matter", ["davisson", "germer", "davisson-germer", "davisson and germer"], "Davisson-Germer Experiment"),
    ("Current Electricity", ["carbon resistor", "colour code", "color code", "carbon composition"], "Carbon Resistors & Colour Code"),
    ("Current Electricity", ["potentiometer"], "Potentiometer"),
]


def rule_label(chapter: Column, text: Column, rules=RULES) -> Column:
    """The label of the first rule that applies, or null: one CASE, evaluated lazily in codegen."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for name, keywords, label in reversed(rules):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit & (chapter == name) if name else hit, label).otherwise(out)
    return out


def tag(questions: DataFrame, rules=RULES) -> DataFrame:
    label = rule_label(F.col("chapter"), F.col("question"), rules)
    return questions.withColumn("removed_reason", label).withColumn("in_syllabus", F.col("removed_reason").isNull())


def rule_table(spark, rules=RULES) -> DataFrame:
    rows = [(r, name, k, word, label) for r, (name, words, label) in enumerate(rules) for k, word in enumerate(words)]
    return spark.createDataFrame(rows, "rule_ord int, chapter string, kw_ord int, keyword string, label string")


GRAM = 4
#: One of so many items tells how frequent grams are; that decides on speed alone.
GRAM_SAMPLE = 1024
FEW_GRAMS = 64
BROADCAST_BYTES = 32 << 20


def _grams(text: Column, size: int, few: list[str] | None = None) -> Column:
    """All runs of so many characters, or those of few."""
    any_of = f".{{{size}}}" if few is None else "|".join(f"\\Q{g}\\E" for g in few if len(g) == size)
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({any_of}))"), F.lit(1)) if size else F.array(F.lit(""))


def _small(rows: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is measured to be small."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def signatures(rules: DataFrame, texts: DataFrame) -> DataFrame:
    """(keyword, gram): of each keyword's runs of GRAM characters, that which the fewest of texts (t) hold;
    a shorter keyword is its own."""
    grams = F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(F.array_distinct(_grams(F.col("keyword"), GRAM)))
    own = rules.select("keyword").distinct().select("keyword", F.explode(grams).alias("gram"))
    some = texts.where(F.pmod(F.xxhash64("t"), F.lit(GRAM_SAMPLE)) == 0)
    seen = some.select(F.explode(F.array_distinct(_grams(F.col("t"), GRAM))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return own.join(seen, "gram", "left").groupBy("keyword").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))


def tag_by_table(questions: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, removed_reason) with rules held in a table (rule_ord, chapter or null, kw_ord, keyword, label).

    Keywords and items meet by an equi-join on a gram that the keyword holds and that few items do; then
    what is left is looked for in the item's own text. Items are known by two hashes of chapter and
    text, so each row has its own label, whatever ids it shares. The rules of an item are tried in order.
    """
    named = rules.where("keyword is not null").select("rule_ord", "kw_ord", "keyword", "label", F.col("chapter").alias("of"))
    row = [F.xxhash64("c", "t").alias("h1"), F.xxhash64(F.lit(1), "t", "c").alias("h2")]
    items = questions.select(F.col(key), F.col("chapter").alias("c"), F.lower("question").alias("t"))
    known = materialize(named.join(signatures(named, items), "keyword"), "signatures")
    sizes = sorted(r["n"] for r in known.select(F.length("gram").alias("n")).distinct().collect())  # GRAM + 1 at most
    if not sizes:
        return questions.select(key, F.lit(None).cast("string").alias("removed_reason"))
    # A few grams are looked for as such; of more, all that the item has are tried.
    few = [r["gram"] for r in known.select("gram").distinct().limit(FEW_GRAMS + 1).collect()]
    few = few if len(few) <= FEW_GRAMS and not any("\\E" in g for g in few) else None
    held = F.array_distinct(F.concat(*(_grams(F.col("t"), n, few) for n in sizes)))
    met = items.where("t is not null").select("c", *row, F.explode(held).alias("gram")).join(_small(known), "gram").where("of is null or of = c")
    tried = F.array_sort(F.collect_set(F.struct("rule_ord", "kw_ord", "keyword", "label"))).alias("tried")
    found = materialize(met.groupBy("h1", "h2").agg(tried), "candidates")
    first = F.filter("tried", lambda r: F.contains(F.col("t"), r["keyword"]))
    return items.select(key, "t", *row).join(_small(found), ["h1", "h2"], "left").select(key, F.get(first, F.lit(0))["label"].alias("removed_reason"))


def missing_answers(questions: DataFrame) -> DataFrame:
    keep = F.coalesce("in_syllabus", F.lit(True)) & (F.coalesce("answer", F.lit("")) == "")
    return questions.where(keep)


def in_syllabus_only(questions: DataFrame) -> DataFrame:
    return questions.where(F.coalesce("in_syllabus", F.lit(True)))


def reason_counts(tagged: DataFrame, order: str = "ord") -> DataFrame:
    """Labels by count, first-seen order among equals."""
    counts = tagged.where("removed_reason is not null").groupBy("removed_reason").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first")


def recount(chapters: DataFrame, questions: DataFrame) -> DataFrame:
    """count_total keeps the former count; count is what is in the syllabus now."""
    now = questions.groupBy(F.col("chapter").alias("name")).agg(F.count_if(F.coalesce("in_syllabus", F.lit(True))).alias("now"))
    joined = chapters.withColumn("count_total", F.col("count")).join(now, "name", "left")
    return joined.withColumn("count", F.coalesce("now", F.lit(0))).select(*dict.fromkeys([*chapters.columns, "count_total"]))


def recount_after_delete(chapters: DataFrame, questions: DataFrame) -> DataFrame:
    now = in_syllabus_only(questions).groupBy(F.col("chapter").alias("name")).agg(F.count("*").alias("now"))
    joined = chapters.drop("count_total").join(now, "name", "left")
    return joined.withColumn("count", F.coalesce("now", F.lit(0))).select(*(c for c in chapters.columns if c != "count_total"))
