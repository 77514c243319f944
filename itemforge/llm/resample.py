"""Target-distribution importance resampling (operator 11): hashed n-gram weights by external sort-count.

A feature is a run of 1 to `longest` consecutive words, joined by one space; its bucket is the crc32
of its UTF-8 bytes modulo `buckets` (65,536 at most). The texts are read once: tasks write streams
of packed 16-bit buckets, some MB a row, with the end of each document in them. Counts come from the
streams: each is a run that is sorted and run-length encoded, a task merges its runs, and Spark sums
what the tasks found, at most `buckets` rows a task. A bucket's gain is the scaled log ratio of its
smoothed share in the target to that in the corpus. Weights come from the streams, too: gains are
gathered by bucket and summed between document ends with np.add.reduceat. Documents then are drawn
without replacement by the largest weight + Gumbel noise, the noise a hash of seed and id.

What reaches the driver and is broadcast is one number a bucket, whatever the corpus. The drawn rows
are ranked without one task for all: by range partitions and the counts of those before.

doc_id is a long (or casts to one). Words are runs of ASCII letters, digits and non-ASCII characters,
A-Z lower-cased. Null and empty texts have no features and weight 0; with min_words above 0 they are
never drawn. Rows with a null id get the noise of an empty id. Repeated rows stay apart and count
each; ties go to the smaller id, null first. Very long texts are whole rows of a stream. An empty
table gives an empty result, an empty target the same share to each bucket. Only doc_id and text are
read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import materialize, release, text_slices
from itemforge.sources.bank import numbered

#: Bytes of text whose buckets go into one row of the stream table, single longer texts apart.
STREAM_BYTES = 4 << 20
#: Buckets of distinct words that a task keeps before it starts anew.
KNOWN_WORDS = 1 << 20
#: A-Z become a-z, other ASCII characters but letters and digits become spaces, the rest stays.
WORD_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
STREAM = "doc_ids array<bigint>, n_words array<bigint>, ends binary, stream binary"


class _Buckets(dict):
    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def bucket_streams(docs: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """docs (doc_id, text) as rows of documents: their ids, numbers of words, ends in the stream
    (64-bit) and the stream itself (unsigned 16-bit), the buckets of all their features."""
    if not 1 <= buckets <= 1 << 16 or longest < 1:
        raise ValueError("1 to 65,536 buckets and features of a word or more are needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = _Buckets(buckets)
        for batch in batches:
            for part in text_slices(batch, "text", rows=1 << 14, size=STREAM_BYTES):
                words = [(t or "").encode().translate(WORD_BYTES).split() for t in part.column("text").to_pylist()]
                count = np.fromiter(map(len, words), np.int64, len(words))
                streams = [np.fromiter(map(known.__getitem__, w), np.uint16, len(w)) for w in words] if longest == 1 else [
                    np.fromiter((known[b" ".join(w[k : k + n])] for n in range(1, longest + 1) for k in range(len(w) - n + 1)), np.uint16) for w in words
                ]
                if len(known) > KNOWN_WORDS:
                    known.clear()
                ends = np.cumsum([len(s) for s in streams], dtype=np.int64)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (part.column("doc_id"), pa.array(count))]
                raw = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (ends.astype("<i8"), np.concatenate(streams).astype("<u2"))]
                yield pa.RecordBatch.from_arrays([*lists, *raw], names=["doc_ids", "n_words", "ends", "stream"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STREAM)


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n) of all features of the streams: sorted runs, run-length encoded and merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for raw in batch.column("stream"):
                ordered = np.sort(np.frombuffer(raw.as_buffer(), "<u2"), kind="stable")  # a radix sort
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[first]] += np.diff(np.append(first, len(ordered)))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    return streams.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of each bucket's smoothed share in the target over that in the corpus)."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document in the streams."""
    shared = streams.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ends = np.frombuffer(batch.column("ends")[k].as_buffer(), "<i8")
                gathered = shared.value[np.frombuffer(batch.column("stream")[k].as_buffer(), "<u2")]
                sizes = np.diff(ends, prepend=0)
                total = np.zeros(len(ends), np.int64)
                if len(gathered):
                    # reduceat takes no empty parts: those without features keep 0.
                    total[sizes > 0] = np.add.reduceat(gathered, (ends - sizes)[sizes > 0])
                columns = [batch.column(c)[k].values for c in ("doc_ids", "n_words")] + [pa.array(sizes), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return streams.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noisy(weight: Column, doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """weight + floor(scale * Gumbel noise), the noise from the first 32 bits of sha256('seed:id')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    uniform = (h.cast("double") + 0.5) / 4294967296.0
    return weight + F.floor(-F.lit(float(scale)) * F.log(-F.log(uniform)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text). rank counts from
    1 over the drawn documents, the percent with the highest scores of those with min_words words, and
    is null for the others. target has a text."""
    streams = materialize(bucket_streams(docs, buckets, longest), "streams")
    wanted = bucket_streams(target.select(F.lit(None).alias("doc_id"), "text"), buckets, longest)
    gains = bucket_gains(_dense(bucket_counts(streams), buckets), _dense(bucket_counts(wanted), buckets))
    found = weights(streams, gains)
    scored = materialize(found.withColumn("score", noisy(F.col("weight"), F.col("doc_id"), seed)), "scores")
    names = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= min_words).select(*names)
    drawn = able.count() * percent // 100
    order = (F.col("score").desc(), F.col("doc_id"), F.col("weight"), F.col("n_features"))
    place = F.col("place") + 1
    ranked = numbered(able, *order, name="place").select(*names, F.when(place <= drawn, place).alias("rank"))
    return ranked.union(scored.where(F.col("n_words") < min_words).select(*names, F.lit(None).cast("long").alias("rank")))
