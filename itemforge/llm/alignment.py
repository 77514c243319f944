"""Cross-tokenizer alignment (operator 13): groups and links between two tokenizers' tokens of a text.

align() is relational: posexplode gives one row a token, a window over each unit sums token sizes to byte
ends, an equi-join on unit and end finds the cuts (ends that both tokenizers share), and running counts of
cuts are the group ids. The range join for the links, one for each pair of tokens whose bytes overlap, is a
running window over both sides' begins: the bytes that two tokens share begin where the later one does,
so that token meets the last one of the other side. So a group of many tokens gives as many links as
it has and never all pairs. Rows are dealt by unit once, and stay there through windows and the join.

The query's units are chunks: a text, with a space before it, is cut before each space or newline that
follows another character than white space. There both tokenizers end a token, so cuts fall on all
chunk borders, and the tokens, groups and links of a text are those of its chunks in order. So each
distinct chunk of the corpus is encoded and aligned once, with the number of its occurrences.

Texts are read once and written as blocks of chunk codes. A block sends its distinct chunks to the shards
of their hashes, where counts are summed and, later, results given back; the block then adds up its
documents. An id pair's count and the highest count of a B id are aggregates over the links weighted by
occurrences; they are broadcast to the links if counted to be at most BROADCAST_PAIRS, joined by shuffle
beyond.

A is a byte-level tokenizer of the tokenizers library, special tokens read as plain text; B is a
SentencePiece model of the kind that llm/pieces reads. Null and empty texts have no tokens, nor have
texts with U+2581, which B can't tell from a space: zeros and an empty string. Repeated rows stay apart
and count each; texts longer than a block are blocks of their own. doc_id is a long (or casts to one). Only
doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itemforge.llm.common import drop, held, materialize, release, text_slices
from itemforge.llm.elias_fano import EliasFano, loose, pack, squeeze
from itemforge.llm.pieces import MARK, SEGMENT, PrefixTable

#: Text of a block, single longer texts apart; distinct chunks that a shard gets about.
BLOCK_BYTES = 5 << 20
SHARD_CHUNKS = 1 << 16
#: Pairs of ids with their counts that may be broadcast, some 50 bytes each.
BROADCAST_PAIRS = 1 << 20
#: What stands at a byte of a unit, in this order.
CUT_HERE, A_BEGINS, B_BEGINS = range(3)
ZSTD_LEVEL = 6
CUT = re.compile(r"(?<!\s)(?=[ \n])")
BLOCK = "block bigint, doc_ids array<bigint>, sizes binary, codes binary, chunks array<string>, hashes binary, counts binary"
#: A distinct chunk: its occurrences, the ids of its A and B tokens, and their sizes in bytes. Or a request: the
#: units of a shard, by number, that a block holds.
UNIT = "unit bigint, n bigint, a array<int>, a_size array<int>, b array<int>, b_size array<int>, block bigint, asked binary"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def chunks_of(text: str | None) -> list[str]:
    """The chunks of space + text; none if the text is empty or can't be spelled by B."""
    if not text or MARK in text:
        return []
    found = CUT.split(" " + text)
    return found[1:] if not found[0] else found


def chunk_blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as blocks: the documents' chunks as codes of the block's distinct chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, made = TaskContext.get().partitionId(), count()

        def block(known, codes, sizes, ids):
            chunks = list(known)
            hashes = np.fromiter(map(zlib.crc32, map(str.encode, chunks)), np.uint32, len(chunks))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            codes = place[np.concatenate(codes)]
            ids = pa.concat_arrays(ids)
            columns = [pa.array([(part << 32) + next(made)]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            columns += [pa.array([x], pa.binary()) for x in (np.concatenate(sizes).astype("<i8").tobytes(), squeeze(codes))]
            columns += [pa.array([[chunks[k] for k in order]], pa.list_(pa.string()))]
            columns += [pa.array([x], pa.binary()) for x in (pack(hashes[order]), squeeze(np.bincount(codes, minlength=len(chunks))))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "sizes", "codes", "chunks", "hashes", "counts"])

        def new():
            return defaultdict(count().__next__), [], [], []

        own, size = new(), 0
        for batch in batches:
            for some in text_slices(batch, "text", rows=1 << 14, size=1 << 20):
                texts = some.column("text").to_pylist()
                more = sum(map(len, filter(None, texts)))
                if size and size + more > BLOCK_BYTES:
                    yield block(*own)
                    own, size = new(), 0
                found = list(map(chunks_of, texts))
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                own[1].append(np.fromiter((own[0][c] for f in found for c in f), np.uint32, int(sizes.sum())))
                own[2].append(sizes)
                own[3].append(some.column("doc_id"))
                size += more
        if own[2]:
            yield block(*own)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


class Tokenizers:
    """Both tokenizers, for chunks."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(a_path), PrefixTable(b_path, cache_bytes=8 << 20)
        self.a.encode_special_tokens = True
        # A's vocabulary spells each byte as one character.
        self.width = np.array([len(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())], np.int64)

    def encode(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and for B: ids, the bytes of each, and ids a chunk."""
        found = [e.ids for at in range(0, len(chunks), 4096) for e in self.a.encode_batch_fast(chunks[at : at + 4096], add_special_tokens=False)]
        ids, sizes = np.array(list(chain.from_iterable(found)), np.int64), np.fromiter(map(len, found), np.int64, len(found))
        raw = [b"".join(map(self.b._ids, SEGMENT.findall(c.replace(" ", MARK)))) for c in chunks]
        own = np.frombuffer(b"".join(raw), "<i4")
        each = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        if len(self.b.pairs) * 100 > self.b.cache_bytes:
            self.b.pairs.clear()
        return [(ids.astype(np.int32), self.width[ids], sizes), (own, self.b.size[own], each)]


def _cuts(hashes: bytes, shards: int) -> np.ndarray:
    """Where each shard's range of 32-bit hashes begins in a block's chunks, and their number."""
    borders = np.array([(k << 32) // shards for k in range(shards)], np.uint64)
    found = EliasFano(hashes).all()
    return np.append(np.searchsorted(found, borders), len(found))


def _packed(chunks: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("chunk", pa.string())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([chunks], names=["chunk"]))
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column("chunk").combine_chunks()


def _parts(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, chunks, counts): the distinct chunks of each block by the shard of their hash, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k in range(batch.num_rows):
                chunks, counts = batch.column("chunks")[k].values, loose(batch.column("counts")[k].as_py())
                cuts = _cuts(batch.column("hashes")[k].as_py(), shards)
                own = np.flatnonzero(np.diff(cuts))
                spans = [(int(cuts[x]), int(cuts[x + 1])) for x in own]
                columns = [pa.array(own, pa.int32()), pa.array([batch.column("block")[k].as_py()] * len(own), pa.int64())]
                columns += [pa.array([_packed(chunks.slice(a, b - a)) for a, b in spans], pa.binary()), pa.array([squeeze(counts[a:b]) for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "chunks", "counts"])

    return blocks.select("block", "chunks", "hashes", "counts").mapInArrow(run, "shard int, block bigint, chunks binary, counts binary")


def chunk_units(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every distinct chunk of the parts once, as a unit, and what each block asks of the shard's units. A
    unit's number is its shard and its place there."""

    def run(table: pa.Table) -> pa.Table:
        tokenizers = held(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))
        each = [_unpacked(c.as_py()) for c in table.column("chunks")]
        coded = pa.concat_arrays(each).dictionary_encode()
        place, chunk = coded.indices.to_numpy(), coded.dictionary
        n = np.zeros(len(chunk), np.int64)
        np.add.at(n, place, np.concatenate([loose(c.as_py()) for c in table.column("counts")]))
        first = table.column("shard")[0].as_py() << 32
        lists, want = [], pc.binary_length(chunk).to_numpy()
        for ids, size, many in tokenizers.encode(chunk.to_pylist()):
            ends = np.concatenate([[0], np.cumsum(many)])
            if (np.diff(np.concatenate([[0], np.cumsum(size)])[ends]) != want).any():
                raise ValueError("the tokens of a chunk don't spell it")
            lists += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, size)]
        names = ["unit", "n", "a", "a_size", "b", "b_size"]
        units = pa.table([pa.array(first + np.arange(len(chunk))), pa.array(n), *lists], names=names)
        cuts = np.cumsum([len(c) for c in each])[:-1]
        asked = [pa.array([first] * len(each), pa.int64()), table.column("block"), pa.array([squeeze(p) for p in np.split(place, cuts)], pa.binary())]
        both = pa.concat_tables([units, pa.table(asked, names=["unit", "block", "asked"])], promote_options="default")
        return both.select([c.split()[0] for c in UNIT.split(", ")])

    return parts.groupBy("shard").applyInArrow(run, UNIT)


#: Numbers in front of a packed unit: A's tokens, and the unit's occurrences as two halves.
PACK_HEAD = 3


def _n_b() -> Column:
    return F.shiftright(F.size("p") - PACK_HEAD, 1) - F.get("p", F.lit(0))


def tokens_of(packed: DataFrame, side: int) -> DataFrame:
    """(unit, id, begin, end) of every token of A (0) or B (1) of align's packed units."""
    n_a = F.get("p", F.lit(0))
    n, at = (n_a, F.lit(PACK_HEAD + 1)) if side == 0 else (_n_b(), 2 * n_a + PACK_HEAD + 1)
    both = F.arrays_zip(F.slice("p", at, n).alias("id"), F.slice("p", at + n, n).alias("size"))
    rows = packed.select("unit", F.posexplode(both).alias("pos", "t")).select("unit", "pos", "t.id", "t.size")
    end = F.sum("size").over(Window.partitionBy("unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).select("unit", "id", (F.col("end") - F.col("size")).alias("begin"), "end")


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Joins on a unit and more keep rows dealt by unit where they are, in plans that run inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align(units: DataFrame) -> DataFrame:
    """(unit, n, n_a, n_b, n_groups, groups, links) of units (unit, n, a, a_size, b, b_size), the ids
    of their tokens and the bytes of each, with n, their occurrences: groups in order as a1,a2|b1;a3|b2,
    and one link for each A and B token that share bytes, A's id and B's in the halves of a long."""
    halves = F.shiftright("n", 31).cast("int"), F.col("n").bitwiseAND((1 << 31) - 1).cast("int")
    # One array holds all of a unit, and no reader adds a filter, so that one exchange serves all below.
    packed = units.where("unit is not null").select("unit", F.concat(F.array(F.size("a"), *halves), "a", "a_size", "b", "b_size").alias("p")).repartition("unit")
    a, b = tokens_of(packed, 0), tokens_of(packed, 1)
    cuts = a.select("unit", "end").join(b.select("unit", "end"), ["unit", "end"])
    none = F.lit(None).cast("int")
    rows = cuts.select("unit", F.col("end").alias("at"), F.lit(CUT_HERE).alias("kind"), none.alias("a"), none.alias("b"))
    rows = rows.union(a.select("unit", "begin", F.lit(A_BEGINS), "id", none)).union(b.select("unit", "begin", F.lit(B_BEGINS), none, "id"))
    so_far = Window.partitionBy("unit").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_cut = F.col("kind") == CUT_HERE
    rows = rows.select(
        "unit", "at", "kind", F.coalesce("a", "b").alias("id"), F.count_if(is_cut).over(so_far).alias("grp"), F.coalesce(F.max(F.when(is_cut, F.col("at"))).over(so_far), F.lit(0)).alias("group_at"),
        F.last("a", ignorenulls=True).over(so_far).alias("a"), F.last("b", ignorenulls=True).over(so_far).alias("b"),
    ).where(~is_cut)
    # Bytes that two tokens share begin where the later one begins: that one meets the last of the other
    # side. Where both begin, B's comes second.
    heads = F.col("at") == F.col("group_at")
    pair = F.when((F.col("kind") == B_BEGINS) | ~heads, F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")))
    mark = F.when(~heads, ",").when(F.col("kind") == B_BEGINS, "|").when(F.col("grp") > 0, ";").otherwise("")
    token = F.struct("grp", "kind", "at", F.concat(mark, F.col("id").cast("string")).alias("text"), pair.alias("pair"))
    found = rows.groupBy("unit").agg(F.array_sort(F.collect_list(token)).alias("tokens"), (F.max("grp") + 1).alias("n_groups"))
    pairs = F.filter(F.transform("tokens", lambda t: t["pair"]), lambda x: x.isNotNull())
    found = found.select("unit", "n_groups", F.array_join(F.transform("tokens", lambda t: t["text"]), "").alias("groups"), pairs.alias("links"))
    n = F.shiftleft(F.get("p", F.lit(1)).cast("long"), 31).bitwiseOR(F.get("p", F.lit(2)).cast("long"))
    sized = packed.select("unit", n.alias("n"), F.get("p", F.lit(0)).cast("long").alias("n_a"), _n_b().cast("long").alias("n_b"))
    return sized.join(found, "unit")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, is_best) of aligned (n, links): links of each id pair in the whole corpus, and whether no
    other A id has more with that B id. A pair is A's id and B's in the halves of a long."""
    n = aligned.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    return n.withColumn("is_best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    blocks = materialize(chunk_blocks(docs), "blocks", "zstd")
    total = blocks.agg(F.sum(F.size("chunks"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHUNKS))
    found = materialize(chunk_units(_parts(blocks, shards), a_path, b_path), "units", "zstd")
    # The chunks' texts, and after the alignment their tokens, aren't read again: the rest goes on without them.
    own = materialize(blocks.select("block", "doc_ids", "sizes", "codes", "hashes"), "codes", "zstd")
    drop(blocks)
    shard = F.shiftright("unit", 32).cast("int").alias("shard")
    with in_place(spark):
        aligned = materialize(align(found.where("block is null")), "aligned", "zstd")
    asked = materialize(found.where("block is not null").select(shard, "block", "asked"), "asked", "zstd")
    drop(found)
    pairs = materialize(pair_counts(aligned), "pairs")
    known = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    # Rows of a unit stand together in the table, so most of the sums are made before the shuffle.
    linked = aligned.select("unit", F.explode("links").alias("pair")).join(known.withColumnRenamed("n", "m"), "pair").groupBy("unit")
    linked = linked.agg(F.count("*").alias("n_links"), F.count_if("is_best").alias("n_best"), F.sum("m").alias("count_sum"))
    # A shard gets its units' own figures and their sums as rows of two kinds.
    none = F.lit(None).cast("long")
    results = aligned.select(shard, "unit", "n_a", "n_b", "n_groups", none.alias("n_links"), none.alias("n_best"), none.alias("count_sum"), "groups")
    results = results.union(linked.select(shard, "unit", none, none, none, "n_links", "n_best", "count_sum", F.lit(None).cast("string")))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        release()
        pa.default_memory_pool().release_unused()
        own = pc.is_valid(known.column("groups"))
        units, sums = known.filter(own).sort_by("unit"), known.filter(pc.invert(own)).sort_by("unit")
        if not units.column("unit").equals(sums.column("unit")):
            raise ValueError("a unit has no sums")
        figures = np.stack([(units if k < 3 else sums).column(c).to_numpy() for k, c in enumerate(FIGURES)])
        groups = units.column("groups").to_pylist()
        out = []
        for packed in asked.column("asked"):
            at = loose(packed.as_py())
            planes = np.ascontiguousarray(figures[:, at]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
            raw = planes + "\n".join(map(groups.__getitem__, at.tolist())).encode()
            out.append(len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=ZSTD_LEVEL).compress(raw, asbytes=True))
        return pa.table([asked.column("block"), asked.column("shard"), pa.array(out, pa.binary())], names=["block", "shard", "answer"])

    answers = asked.groupBy("shard").cogroup(results.groupBy("shard")).applyInArrow(answer, "block bigint, shard int, answer binary")

    def finish(block: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        pa.default_memory_pool().release_unused()
        row = block.to_pylist()[0]
        sizes = np.frombuffer(row["sizes"], "<i8")
        codes, cuts = loose(row["codes"]), _cuts(row["hashes"], shards)
        figures, groups = np.zeros((6, cuts[-1]), np.int64), np.empty(cuts[-1], object)
        for r in answers.to_pylist():
            a, b = cuts[r["shard"] : r["shard"] + 2]
            raw = pa.Codec("zstd").decompress(r["answer"][8:], int.from_bytes(r["answer"][:8], "little"), asbytes=True)
            planes = np.frombuffer(raw, np.uint8, 48 * (b - a)).reshape(8, -1)
            figures[:, a:b] = np.ascontiguousarray(planes.T).view("<i8").reshape(6, -1)
            groups[a:b] = raw[48 * (b - a) :].decode().split("\n")
        ends = np.cumsum(sizes)
        totals = np.zeros((6, len(sizes)), np.int64)
        has = sizes > 0
        for k in range(6 if has.any() else 0):
            totals[k, has] = np.add.reduceat(figures[k][codes], (ends - sizes)[has])
        out = []
        for at in range(0, len(sizes), 128):  # strings are long: they go on a few at a time
            some = slice(at, at + 128)
            strings = pa.array([";".join(groups[codes[e - s : e]]) for s, e in zip(sizes[some].tolist(), ends[some].tolist(), strict=True)], pa.string())
            columns = [pa.array(row["doc_ids"][some], pa.int64()), *(pa.array(t[some]) for t in totals), strings]
            out.append(pa.record_batch(columns, names=["doc_id", *FIGURES, "groups"]))
        return pa.Table.from_batches(out)

    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, RESULT)
