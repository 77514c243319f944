"""Token counts (operator 1): find end-of-document ids in flat, unindexed token files.

A flat file is a run of little-endian ids of 16 or 32 bits, each document ended by the separator id. It is
scanned in fixed-size blocks that know nothing of documents. In each block one vectorised search
finds the separators; counts of whole documents come out at once, and the ids before the first and
after the last separator are stitched to the neighbouring blocks by a prefix scan over the blocks'
summaries (one small row a block).

Empty documents are a separator alone (0 ids before it). Ids after a file's last separator are an
unended document, counted with ended = false. A file without ids has no documents. Null texts are
empty; null doc_ids are counted like others; repeated rows stay apart; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.bpe_cache import encoder, with_ends
from itemforge.llm.common import materialize, release, scratch_path, text_or_empty, text_slices

BLOCK_IDS = 1 << 18
TEXT_SLICE = 1 << 20  # bytes of text encoded at once: a slice needs some 20 times that beside it
CACHE_BYTES = 64 << 20  # chunks kept by a worker that writes flat files
FLAT = "kind string, file int, block int, n long, payload binary"


def flat_blocks(spark: SparkSession, glob: str, block_ids: int = BLOCK_IDS, dtype: str = "<u4") -> DataFrame:
    """Blocks (file, block, payload) of flat files in any store that Spark reads. file is the path."""

    step = block_ids * np.dtype(dtype).itemsize

    def cut(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                for k, at in enumerate(range(0, len(data), step)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([k], pa.int32()), pa.array([bytes(data[at : at + step])])],
                        names=["file", "block", "payload"],
                    )

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInArrow(cut, "file string, block int, payload binary")


def scan_blocks(blocks: DataFrame, separator: int, dtype: str = "<u4") -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in blocks (file, block, payload)."""
    kind = blocks.schema["file"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # the encoder of the worker's former tasks
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("payload")[i].as_buffer(), dtype)
                at = np.flatnonzero(ids == separator)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("file").slice(i, 1),
                        batch.column("block").slice(i, 1),
                        pa.array([len(at)], pa.int64()),
                        pa.array([int(at[0]) if len(at) else len(ids)], pa.int64()),
                        pa.array([len(ids) - int(at[-1]) - 1 if len(at) else len(ids)], pa.int64()),
                        pa.array([(np.diff(at) - 1).tolist()], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "seps", "head", "tail", "whole"],
                )

    schema = f"file {kind.simpleString()}, block int, seps long, head long, tail long, whole array<bigint>"
    found = materialize(blocks.select("file", "block", "payload").mapInArrow(scan, schema), "separators")
    # The scan over the blocks' summaries: a few numbers a block, never the documents' lengths.
    order = Window.partitionBy("file").orderBy("block")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    # group: separators-bearing blocks before this one; the open document began in the last of them.
    stitched = found.drop("whole").withColumn("ordinal", F.coalesce(F.sum("seps").over(ahead), F.lit(0))).withColumn(
        "grp", F.coalesce(F.sum((F.col("seps") > 0).cast("long")).over(ahead), F.lit(0))
    )
    open_ = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.last(F.when(F.col("seps") > 0, F.col("tail")), ignorenulls=True).over(ahead)
    stitched = stitched.withColumn(
        "carry",
        # tail of the last block that has a separator, and all of the blocks without one since then
        F.coalesce(last_tail, F.lit(0)) + F.coalesce(F.sum(F.when(F.col("seps") == 0, F.col("tail"))).over(open_), F.lit(0)),
    ).withColumn("is_last", F.lead("block").over(order).isNull())
    sizes = F.concat(F.array(F.col("carry") + F.col("head")), F.col("whole"))
    known = ["file", "block"]
    lengths = found.where("seps > 0").select(*known, "whole").join(stitched.where("seps > 0"), known)
    rest = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    ended = lengths.select("file", "ordinal", F.posexplode(sizes).alias("k", "n_tokens"))
    left = stitched.where("is_last").where(rest > 0)
    return ended.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended")).unionByName(
        left.select("file", (F.col("ordinal") + F.col("seps")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended"))
    )


def flat_rows(batches: Iterator[pa.RecordBatch], file: int, vocabulary: str, separator: int, block_ids: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows of FLAT of one run: its ids in blocks, and the doc_ids of each slice of its texts."""
    size = np.dtype(dtype).itemsize
    step = block_ids * size

    def row(kind, block, n, payload):
        return pa.RecordBatch.from_arrays(
            [pa.array([kind]), pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())],
            names=["kind", "file", "block", "n", "payload"],
        )

    block, seen = 0, 0
    # As text: the id of an added token in a document would read as a separator.
    enc, flat = encoder(vocabulary, special_as_text=True, cache_bytes=CACHE_BYTES), bytearray()
    if max(separator, enc.tokenizer.get_vocab_size() - 1) >> 8 * size:
        raise ValueError(f"ids of this vocabulary don't fit {dtype}")
    for batch in batches:
        for part in text_slices(batch, "text", rows=1 << 14, size=TEXT_SLICE):
            flat += with_ends(*enc.encode(part.column("text")), separator).astype(dtype).tobytes()
            names = part.column("doc_id").to_numpy(zero_copy_only=False) if not part.column("doc_id").null_count else None
            known = np.array([d is not None for d in part.column("doc_id").to_pylist()], "u1")
            values = part.column("doc_id").fill_null(0).to_numpy() if names is None else names
            yield row("docs", seen, part.num_rows, known.tobytes() + values.astype("<i8").tobytes())
            seen += part.num_rows
            while len(flat) >= step:
                yield row("ids", block, block_ids, bytes(flat[:step]))
                del flat[:step]
                block += 1
    if flat:
        yield row("ids", block, len(flat) // size, bytes(flat))


def write_flat(docs: DataFrame, path: str, vocabulary: str, separator: int, block_ids: int = BLOCK_IDS, dtype: str = "<u4") -> None:
    """Encode (doc_id, text) into flat id runs, one for each partition of docs as it stands (no
    shuffle), cut into blocks (kind 'ids'), with the order of the documents beside them (kind
    'docs'), partitioned by kind."""

    def encode(batches):
        from pyspark import TaskContext

        return flat_rows(batches, TaskContext.get().partitionId(), vocabulary, separator, block_ids, dtype)

    (
        docs.select("doc_id", text_or_empty().alias("text"))
        .mapInArrow(encode, FLAT)
        .write.partitionBy("kind")
        .parquet(path)
    )


def token_counts(docs: DataFrame, vocabulary: str, separator: int = 50256, block_ids: int = BLOCK_IDS, dtype: str = "<u2") -> DataFrame:
    """(doc_id, file, ordinal, n_tokens) of every document, counted from flat token files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "flat")
    write_flat(docs, path, vocabulary, separator, block_ids, dtype)
    stored = spark.read.schema("file int, block int, n long, payload binary, kind string").option("basePath", path).parquet(path)

    def names(batches):
        release()
        for batch in batches:
            for i in range(batch.num_rows):
                n, first = batch.column("n")[i].as_py(), batch.column("block")[i].as_py()
                raw = batch.column("payload")[i].as_py()
                known = np.frombuffer(raw, "u1", n) == 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("file")[i].as_py()), pa.int32()),
                        pa.array(np.arange(first, first + n)),
                        pa.array(np.frombuffer(raw, "<i8", n, n), mask=~known),
                    ],
                    names=["file", "ordinal", "doc_id"],
                )

    ids = stored.where("kind = 'docs'").select("file", "block", "n", "payload").mapInArrow(names, "file int, ordinal long, doc_id long")
    counts = scan_blocks(stored.where("kind = 'ids'").select("file", "block", "payload"), separator, dtype)
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
