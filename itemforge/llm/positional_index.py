"""Benchmark decontamination (operator 10): a positional inverted index over the training words.

Words are runs of ASCII letters and digits, A-Z lower-cased, and non-ASCII characters. The index is
a written table of postings (term, doc_id, pos). Test items give windows of `width` consecutive
words (an item with fewer words is one window). Corpus counts of the test terms order each
window's terms from the rarest; the lists of its `depth` rarest terms are fetched and intersected
after subtracting each term's offset in the window, the rarest list first. What is left is a
handful of (document, start) pairs, compared with the whole window in the document's own words.
Only the terms that some window needs are indexed, unless postings() is asked for all.

Only DataFrame and SQL functions are used. The test terms, and the windows by their rarest term, are
broadcast when counted to be at most BROADCAST_BYTES, and joined by shuffle beyond.

Rows are told apart by two hashes of id and text, so rows with a null id, and rows that share one,
have their own results; equal rows have equal ones. Null texts have no words; items without words
have no window; repeated windows and items are found once. A candidate's words and the window are
compared by two 64-bit hashes of the whole window. Very long texts are rows like others: their hits
are starts only. Empty tables give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20
WIDTH, DEPTH = 10, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    c = F.col(text)
    # lower() is much faster, and the same where every character is ASCII.
    low = F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _small(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """A materialized table, marked for broadcast if it is measured to be small."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64)).first()[0] or 0
    return F.broadcast(rows) if size <= (BROADCAST_BYTES if limit is None else limit) else rows


def row_key() -> list[Column]:
    """(h1, h2) of a row's doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("h2")]


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, terms, len, w1, w2) for each window of items (item_id, text); w1 and w2 are hashes
    of the terms joined."""
    found = items.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(width))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - size + 1))
    found = found.select("item_id", "words", size.alias("len"), starts.alias("at"))
    found = found.select("item_id", F.slice("words", F.col("at"), F.col("len")).alias("terms"), "len")
    return found.select("*", *_window_key(F.array_join("terms", " "))).distinct()


def _window_key(w: Column) -> list[Column]:
    return [F.xxhash64(w).alias("w1"), F.xxhash64(F.lit(1), w).alias("w2")]


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, pos) of docs (doc_id, text), of all terms or of those in terms (term)."""
    found = docs.where("doc_id is not null").select("doc_id", F.posexplode(words_of("text")).alias("pos", "term"))
    found = found if terms is None else found.join(_small(terms), "term")
    return found.select("term", "doc_id", "pos")


def corpus_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, cf): occurrences in all of docs of each of terms that occurs."""
    words = docs.select(F.explode(words_of("text")).alias("term"))
    return words.join(_small(terms), "term").groupBy("term").agg(F.count("*").alias("cf"))


def needed_postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, h1, h2, pos, doc_id) of docs (doc_id, text, h1, h2) for terms (term). Each row also has
    one posting of the empty term, behind its last word: pos is its number of words."""
    words = F.array_append(F.coalesce(words_of("text"), F.array().cast("array<string>")), F.lit(""))
    terms = terms.union(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    found = docs.select("doc_id", "h1", "h2", F.posexplode(words).alias("pos", "term")).join(_small(terms), "term")
    return found.select("term", "h1", "h2", "pos", F.when(F.col("term") == "", F.col("doc_id")).alias("doc_id"))


def phrase_starts(docs: DataFrame, wins: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(postings, (h1, h2, start, w1, w2, len)): where the windows' rarest terms occur at their offsets."""
    wins = materialize(wins.select("w1", "w2", "terms", "len").dropDuplicates(["w1", "w2"]), "windows")
    spread = wins.select("w1", "w2", "len", F.posexplode("terms").alias("off", "term"))
    vocabulary = materialize(spread.select("term").distinct(), "terms")
    cf = materialize(corpus_counts(docs, vocabulary), "cf")
    # A window with a term that occurs nowhere can't occur: the join leaves it too few terms.
    ranked = spread.join(cf, "term").groupBy("w1", "w2", "len").agg(F.array_sort(F.collect_list(F.struct("cf", "off", "term"))).alias("by_rarity"))
    ranked = ranked.where(F.size("by_rarity") == F.col("len")).select("w1", "w2", "len", F.slice("by_rarity", 1, depth).alias("rare"))
    ranked = materialize(ranked.withColumns({"term": F.col("rare")[0]["term"], "off": F.col("rare")[0]["off"]}), "ranked")
    needed = materialize(ranked.select(F.explode("rare").alias("r")).select("r.term").distinct(), "terms")
    index = materialize(needed_postings(docs, needed), "postings")
    # The windows go to the postings, if they are few: then no term's list moves, however long.
    key = ["h1", "h2", "start", "w1", "w2", "len", "rare"]
    found = index.join(_small(ranked), "term").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0").select(*key)
    for k in range(1, depth):
        # The k-th rarest list, moved back by its offset, meets what is left. Shorter windows wait.
        nxt = F.get("rare", F.lit(k))
        ready = found.where(F.size("rare") > k).withColumn("term", nxt["term"]).withColumn("pos", F.col("start") + nxt["off"])
        met = ready.join(index, ["term", "h1", "h2", "pos"], "left_semi").select(*key)
        found = materialize(met.union(found.where(F.size("rare") <= k)), "met")
    return index, found.select("h1", "h2", "start", "w1", "w2", "len").distinct()


def confirm(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """(h1, h2, n_hit, hits: array of (w1, w2)): the windows that stand whole in a row's own words,
    and the number of words that they cover."""
    by_row = materialize(starts.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "len", "w1", "w2")).alias("hits")), "candidates")

    def same(words: Column, h: Column) -> Column:
        w1, w2 = _window_key(F.array_join(F.slice(words, h["start"] + 1, h["len"]), " "))
        return (w1 == h["w1"]) & (w2 == h["w2"])

    # The words are the one element of an array, so that they are split once and not once a hit.
    kept = F.transform(F.array(words_of("text")), lambda words: F.filter("hits", lambda h: same(words, h)))[0]
    # Texts stay where they are if the candidates are few.
    found = docs.join(_small(by_row), ["h1", "h2"]).select("h1", "h2", F.array_sort(kept).alias("hits")).where(F.size("hits") > 0)

    def add(acc: Column, h: Column) -> Column:
        end = h["start"] + h["len"]
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["upto"], h["start"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    covered = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), add, lambda acc: acc["n"])
    which = F.array_distinct(F.transform("hits", lambda h: F.struct(h["w1"].alias("w1"), h["w2"].alias("w2"))))
    return found.select("h1", "h2", covered.cast("long").alias("n_hit"), which.alias("hits")).dropDuplicates(["h1", "h2"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_words, n_hit, items: sorted array of item ids as strings, h1, h2) of every row of
    docs (doc_id, text); h1 and h2 as row_key() makes them."""
    wins = materialize(windows(items, width), "items")
    docs = docs.select("doc_id", "text", *row_key())
    index, starts = phrase_starts(docs, wins, depth)
    found = materialize(confirm(docs, starts), "hits")
    which = found.select("h1", "h2", F.explode("hits").alias("w")).select("h1", "h2", "w.*")
    named = which.join(wins.select("w1", "w2", F.col("item_id").cast("string").alias("item")).distinct(), ["w1", "w2"])
    named = named.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = index.where("term = ''").select("doc_id", "h1", "h2", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(found.select("h1", "h2", "n_hit").join(named, ["h1", "h2"], "left"), ["h1", "h2"], "left")
    items_ = F.coalesce("items", F.array().cast("array<string>")).alias("items")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), items_, "h1", "h2")


def phrase_matches(index: DataFrame, phrase: list[str]) -> DataFrame:
    """(doc_id, start) of the exact phrase, from postings alone: all lists moved back and met."""
    lists = [index.where(F.col("term") == t).select("doc_id", (F.col("pos") - k).alias("start")) for k, t in enumerate(phrase)]
    return reduce(lambda a, b: a.join(b, ["doc_id", "start"], "left_semi"), lists)


def proximity_matches(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """(doc_id, pos) of terms[0] that have every other term within slop words, by a bucketed range join."""
    out = index.where(F.col("term") == terms[0]).select("doc_id", "pos")
    for t in terms[1:]:
        width = slop + 1
        near = index.where(F.col("term") == t).select("doc_id", F.col("pos").alias("q"), F.explode(F.array(*(F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)))).alias("bucket"))
        here = out.withColumn("bucket", F.floor(F.col("pos") / width))
        out = here.join(near, ["doc_id", "bucket"]).where(F.abs(F.col("pos") - F.col("q")) <= slop).select("doc_id", "pos").distinct()
    return out
