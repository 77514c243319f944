"""Token-ID / binary output (operator 4): a wavelet matrix per shard of token ids.

File format: a Parquet table of blocks (shard, block, n_docs, n_tokens, payload). Each task of the
range-partitioned writer makes one shard, so one file; a payload is one self-contained wavelet
matrix of about `block_tokens` ids with its document directory:

    "WVM1", levels u32, n_docs u64, n_tokens u64, n_null u64,
    doc_id i64[n_docs] (null ids come first; n_null of them), end i64[n_docs],
    then for each bit, highest first: zeros u64, rank u32[n/512 + 1], bits u8[n/8]

Spark's own writer commits the files to the shared folder, so a lost executor only repeats tasks.
Nulls: a null text is an empty one, a null doc_id sorts first. Repeated rows stay apart. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge.llm.bpe_cache import encoder, with_ends
from itemforge.llm.common import scratch_path, text_or_empty, text_slices

HEAD = struct.Struct("<4sIQQQ")
STEP = 512  # bits between two stored ranks
BLOCK_TOKENS = 1 << 20
TEXT_SLICE = 8 << 20  # bytes of text encoded at once
SHARD_BYTES = 256 << 20  # of text
BLOCKS = "shard int, block int, n_docs long, n_tokens long, payload binary"


def build(ids: np.ndarray, levels: int) -> list[bytes]:
    """Bit planes, highest bit first; each level sorts stably by its bit before the next."""
    parts = []
    seq = ids
    for level in range(levels - 1, -1, -1):
        one = (seq >> level & 1).astype(bool)
        packed = np.packbits(one, bitorder="little")
        padded = np.zeros(-(-len(one) // STEP) * (STEP // 8), np.uint8)
        padded[: len(packed)] = packed
        per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, STEP // 64).sum(1, dtype=np.uint32)
        rank = np.concatenate([np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32)])
        # Taking by positions is several times faster than by a mask of mixed bits.
        zeros = seq.take(np.flatnonzero(~one))
        parts += [struct.pack("<Q", len(zeros)), rank.tobytes(), padded.tobytes()]
        seq = np.concatenate([zeros, seq.take(np.flatnonzero(one))])
    return parts


class WaveletMatrix:
    """Random access, counting and occurrence lookup on one payload, without unpacking it."""

    def __init__(self, payload: bytes):
        magic, self.levels, n_docs, self.n, n_null = HEAD.unpack_from(payload)
        if magic != b"WVM1":
            raise ValueError("not a wavelet block")
        at = HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", n_docs, at)
        self.doc_null = np.arange(n_docs) < n_null
        self.ends = np.frombuffer(payload, "<i8", n_docs, at := at + 8 * n_docs)
        at += 8 * n_docs
        steps = -(-self.n // STEP)
        self.planes = []
        for _ in range(self.levels):
            (zeros,) = struct.unpack_from("<Q", payload, at)
            rank = np.frombuffer(payload, "<u4", steps + 1, at + 8)
            bits = np.frombuffer(payload, np.uint8, steps * STEP // 8, at := at + 8 + 4 * (steps + 1))
            at += steps * STEP // 8
            self.planes.append((zeros, rank, bits))

    @staticmethod
    def _ones(plane, i: int) -> int:
        """Ones before position i."""
        _, rank, bits = plane
        k, whole = i // STEP, i // 8
        ones = int(rank[k]) + int(np.bitwise_count(bits[k * STEP // 8 : whole]).sum())
        return ones + (int(bits[whole]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def access(self, i: int) -> int:
        value = 0
        for plane in self.planes:
            one = int(plane[2][i // 8]) >> (i % 8) & 1
            ones = self._ones(plane, i)
            i = plane[0] + ones if one else i - ones
            value = value << 1 | one
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level, plane in enumerate(self.planes):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            lo, hi = (plane[0] + a, plane[0] + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token in positions lo to hi (rank)."""
        if token >> self.levels:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0 (select); IndexError if there are fewer."""
        if token >> self.levels:
            raise IndexError(k)
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            plane = self.planes[level]
            one = token >> (self.levels - 1 - level) & 1
            i = self._select(plane, one, i - plane[0] if one else i)
        return i

    def _select(self, plane, one: int, k: int) -> int:
        _, rank, bits = plane
        at = rank.astype(np.int64) if one else np.arange(len(rank)) * STEP - rank
        step = int(np.searchsorted(at, k, side="right")) - 1
        inside = np.unpackbits(bits[step * STEP // 8 : (step + 1) * STEP // 8], bitorder="little") == one
        return step * STEP + int(np.flatnonzero(inside)[k - int(at[step])])

    def all(self) -> np.ndarray:
        """Every id in order: the stable sorts undone from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level, (zeros, _, bits) in enumerate(reversed(self.planes)):
            one = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[np.flatnonzero(~one)] = out[:zeros]
            above[np.flatnonzero(one)] = out[zeros:] | out.dtype.type(1 << level)
            out = above
        return out


def pack(doc_ids: list, ids: np.ndarray, sizes: np.ndarray, levels: int) -> tuple[int, bytes]:
    """Number of ids, and the payload of documents that lie one after the other in ids."""
    n_null = sum(d is None for d in doc_ids)
    head = HEAD.pack(b"WVM1", levels, len(sizes), len(ids), n_null)
    directory = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.cumsum(sizes).astype("<i8").tobytes()
    return len(ids), b"".join([head, directory, *build(ids.astype(np.uint16 if levels <= 16 else np.uint32), levels)])


def write_shards(
    docs: DataFrame, path: str, vocabulary: str, shards: int, end_id: int, block_tokens: int = BLOCK_TOKENS,
    special_as_text: bool = True,
) -> None:
    """Encode (doc_id, text) in ascending doc_id order and write the blocks to path. Without
    special_as_text, an added token's text becomes its id, as in the library's default call."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary, special_as_text)
        levels = max(enc.tokenizer.get_vocab_size() - 1, end_id).bit_length()
        ids: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal ids, held, sizes, size, block
            n, payload = pack(ids, np.concatenate(held), np.concatenate(sizes), levels)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())],
                names=["shard", "block", "n_docs", "n_tokens", "payload"],
            )
            ids, held, sizes, size, block = [], [], [], 0, block + 1
            return row

        for batch in batches:
            for part in text_slices(batch, "text", rows=1 << 14, size=TEXT_SLICE):
                x, each = enc.encode(part.column("text"))
                x, each, known = with_ends(x, each, end_id), each + 1, part.column("doc_id").to_pylist()
                upto, at, done = np.cumsum(each), 0, 0
                while at < len(known):
                    # Documents up to the one that fills the block.
                    to = min(int(np.searchsorted(upto, done + block_tokens - size)) + 1, len(known))
                    ids += known[at:to]
                    held.append(x[done : upto[to - 1]])
                    sizes.append(each[at:to])
                    size += int(upto[to - 1]) - done
                    at, done = to, int(upto[to - 1])
                    if size >= block_tokens:
                        yield flush()
        if ids:
            yield flush()

    (
        docs.select("doc_id", text_or_empty().alias("text"))
        # The text's hash splits a doc_id that very many rows share (or lack).
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(encode, BLOCKS)
        .write.parquet(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone."""
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                w = WaveletMatrix(batch.column("payload")[i].as_py())
                raw = memoryview(w.all().astype("<u4").tobytes())
                ends = w.ends.tolist()
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.doc_ids, pa.int64(), mask=w.doc_null),
                        pa.array(np.full(n, batch.column("shard")[i].as_py()), pa.int32()),
                        pa.array(np.full(n, batch.column("block")[i].as_py()), pa.int32()),
                        pa.array(np.array(starts, np.int64)),
                        pa.array(np.diff(w.ends, prepend=0)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "shard", "block", "local_start", "n_tokens", "ids_crc32"],
                )

    # Offsets in two steps, so that no single task sees more rows than there are shards.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("in_shard"))
    whole = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    offset = inside.join(base, "shard").select("shard", "block", (F.col("base") + F.col("in_shard")).alias("offset"))
    docs = blocks.select("shard", "block", "payload").mapInArrow(
        decode, "doc_id long, shard int, block int, local_start long, n_tokens long, ids_crc32 long"
    )
    return docs.join(offset, ["shard", "block"]).select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def _answers(blocks: DataFrame, columns: list[str], answer, schema: str) -> DataFrame:
    """answer(wavelet matrix, row) in place of each row's payload, as the column "found"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [answer(WaveletMatrix(r["payload"]), r) for r in batch.to_pylist()]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.int64()))], names=[*columns, "found"])

    return blocks.mapInArrow(run, schema)


def shard_counts(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, block, n_tokens, n, offset, before): the occurrences n of a token in each block, the
    position of the block in its shard, and the occurrences in the shard before it."""
    blocks = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "n_tokens", "payload")
    found = _answers(blocks, ["shard", "block", "n_tokens"], lambda w, r: [w.count(token)], "shard int, block int, n_tokens long, found array<long>")
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = found.select("shard", "block", "n_tokens", F.col("found")[0].alias("n"))
    return n.select("*", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("offset"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))


def shard_count(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, n): the occurrences of a token in each whole shard."""
    return shard_counts(spark, path, token).groupBy("shard").agg(F.sum("n").alias("n"))


def shard_locate(spark: SparkSession, path: str, token: int, k: int) -> DataFrame:
    """(shard, position) of occurrence k (from 0) of a token; shards with fewer have no row."""
    at = shard_counts(spark, path, token).where((F.col("before") <= k) & (F.col("before") + F.col("n") > k))
    blocks = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "payload")
    rows = blocks.join(at.select("shard", "block", "offset", "before"), ["shard", "block"])
    found = _answers(rows, ["shard", "offset"], lambda w, r: [w.locate(token, k - r["before"])], "shard int, offset long, found array<long>")
    return found.select("shard", (F.col("offset") + F.col("found")[0]).alias("position"))


def shard_access(positions: DataFrame, path: str) -> DataFrame:
    """(shard, position, token) of the distinct (shard, position) in positions; those outside the
    shard have no row."""
    spark = positions.sparkSession
    blocks = spark.read.schema(BLOCKS).parquet(path)
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", "n_tokens", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("offset"))
    inside = (F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + F.col("n_tokens"))
    asked = positions.select("shard", "position").distinct().join(starts, "shard").where(inside)
    asked = asked.groupBy("shard", "block", "offset").agg(F.collect_list("position").alias("at"))
    rows = blocks.select("shard", "block", "payload").join(asked, ["shard", "block"])
    found = _answers(rows, ["shard", "at"], lambda w, r: [w.access(p - r["offset"]) for p in r["at"]], "shard int, at array<long>, found array<long>")
    both = found.select("shard", F.explode(F.arrays_zip("at", "found")).alias("x"))
    return both.select("shard", F.col("x.at").alias("position"), F.col("x.found").alias("token"))


def token_output(docs: DataFrame, vocabulary: str, end_id: int = 2, shards: int | None = None, special_as_text: bool = True) -> DataFrame:
    """Write the documents' ids as wavelet shards in the shared folder and read them back. Without a
    number of shards, there are as many as the session's shuffle partitions, or more for more text."""
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    path = scratch_path(spark, "wavelet")
    write_shards(docs, path, vocabulary, shards, end_id, special_as_text=special_as_text)
    return read_documents(spark, path)
