"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.separators import token_counts

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.language import fold, identify, train

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    model = train(docs.where(fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("random"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.wavelet import token_output

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special_as_text=False)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.sharding import shard

    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law")
    )
    return shard(docs, 16).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.metric_join import near_components

    return near_components(table(spark, sf_dir, "embeddings"), 0.98)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.language import fold
    from itemforge.llm.quality import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(fold("doc_id", 5) != 0))
    out = score(docs.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))), model)
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.pieces import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.near_dup import near_components

    return near_components(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.positional_index import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, buckets=10_000, longest=1, seed=2024)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.language import fold
    from itemforge.llm.language_model import score_corpus

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) != 2).alias("learn"))
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return score_corpus(docs).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from itemforge.llm.alignment import FIGURES, alignments

    docs = table(spark, sf_dir, "documents")
    found = alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    return found.select("doc_id", *FIGURES, digest)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


LINKED_SQL = """
reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
"""

OP6_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), u AS (SELECT id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
edges AS (
  SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.label = y.label AND x.id <> y.id
  WHERE list_dot_product(x.e, y.e) / x.norm / y.norm >= 0.98
), nodes AS (SELECT vec_id AS id FROM embeddings), {LINKED_SQL}
SELECT c.id AS vec_id, count(e.a) AS n_links, c.component_id, c.id = c.component_id AS kept
FROM component c LEFT JOIN edges e ON e.a = c.id GROUP BY c.id, c.component_id
"""

OP9_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), sets AS (
  SELECT id, list_distinct(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda k: array_to_string(words[k : k + 2], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w
), each AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT p.id AS a, q.id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS common FROM each p JOIN each q ON p.x = q.x AND p.id <> q.id GROUP BY p.id, q.id),
edges AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
nodes AS (SELECT id FROM sets), {LINKED_SQL}
SELECT s.id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.id = c.component_id AS kept FROM sets s JOIN component c ON c.id = s.id
"""

OP10_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {OP10_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {OP10_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM b)),
grams AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM wins))),
hits AS (SELECT doc_id, item_id, k, n FROM grams JOIN wins USING (n, g)),
spots AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN named USING (doc_id)
"""


#: crc32 by its table of 256 values, made here by the rule, over the bytes of each distinct word.
OP11_SQL = f"""
WITH crc AS (
  SELECT list(list_reduce([CAST(i AS BIGINT), 1, 1, 1, 1, 1, 1, 1, 1], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), d AS (SELECT doc_id, {OP10_WORDS} AS w FROM documents),
words AS (SELECT unnest(w) AS word FROM d), target AS (SELECT unnest({OP10_WORDS}) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM words UNION ALL SELECT word FROM target)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(h) + 1, 2), lambda k: CAST('0x' || h[k : k + 1] AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc
),
s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
gains AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (totals.t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
),
weights AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
  FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
),
scored AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {"op6_embedding_dedup": OP6_SQL, "op9_minhash_dedup": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_importance_resampling": OP11_SQL}
