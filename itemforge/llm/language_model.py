"""LM scoring (operator 12): an n-gram trie of Elias-Fano levels, cut into shards that tasks build and ask.

Tokens are words between ASCII white space, A-Z lower-cased, and one end a text. The model is a
trigram with Dirichlet smoothing down to add-one unigrams:
  P1(w) = (c(w) + 1) / (N + V + 1),  P2(w|v) = (c(vw) + k2 P1(w)) / (c(v) + k2),
  P3(w|uv) = (c(uvw) + k3 P2(w|v)) / (c(uv) + k3),
with counts c over the training texts; a text begins with two starts. They sum to 1 over V words and one
unknown word.

The trie grows backwards: a word, the word before it, the one before that. Its levels are the words
(64-bit hashes, exact counts), the bigrams (46 bits of a hash) and, below each bigram, its first words
(18 bits), relative to the bigram: a level is one monotone Elias-Fano sequence in which every bigram's
children start where those of the bigram before end, and pointers, monotone too, tell where. A query
finds the bigram by a successor search and then its child by another one from the bigram's base.
Nodes keep their log probability in the corpus as a 16-bit code (exact below 32,768 occurrences, steps
of 0.07 % above); the smoothed conditional probability is worked out from the codes of the n-gram, its
context and its suffix, which lie in different shards. A shard is one flat buffer that is read in place,
from a memory-mapped file as well (TrieLevel.map).

The work is exchanged by blocks and shards. The texts are read once and written as blocks of token codes.
Each block sends its distinct words, and its distinct n-grams with their training counts, to the shards
of their hashes; a shard sums, builds its part of the trie, answers each block with codes in the block's
order, and the block scores its documents. So what moves is a few bytes for each distinct n-gram of a
block, a frequent n-gram comes once from each block, and no task or driver holds the model. Shards are
ranges of n-grams drawn from a sample, so a bigram with very many children may lie in several: blocks
then ask all of those and add what they find.

N-grams are known by hash: with 10^12 different bigrams 1 in 70 lookups of an unseen one finds another's
node; at 10^10, 1 in 7,000. Words are known by 64 bits. base_score, n_known and train_tokens use exact counts.

doc_id is a long (or casts to one). Null and empty texts are one end. With nothing to learn from, every
score is 0. Repeated rows stay apart and count each. A text longer than a block is a block. Only
doc_id, text and the learn column are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import materialize, release, text_slices
from itemforge.llm.elias_fano import EliasFano, distinct, loose, pack, squeeze, starts

#: Text of a block, single longer texts apart; distinct words or n-grams that a shard gets about.
BLOCK_BYTES = 8 << 20
SHARD_KEYS = 1 << 19
#: Prior weights of the lower order: in bigrams, in trigrams.
K2, K3 = 300.0, 20.0
CHILD_BITS = 18
#: One of so many n-grams of a block goes into the sample for the shards' borders; borders use so many at most.
SAMPLE_STEP, SAMPLE = 1 << 12, 1 << 16
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
EXACT, STEPS = 1 << 15, 1000.0
BLOCK = "block bigint, doc_ids array<bigint>, learn array<boolean>, sizes binary, words binary, codes binary, n_words bigint, n_tokens bigint, n_learn bigint, sample array<bigint>"
WORDS, NGRAMS = 1, 3


def coded(counts: np.ndarray) -> np.ndarray:
    """Occurrences as 16-bit codes of their logarithm, rounded down, so that no n-gram has more than its context."""
    c = counts.astype(np.float64)
    return np.where(counts < EXACT, counts, EXACT + np.floor(STEPS * np.log2(np.maximum(c, EXACT) / EXACT))).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.float64)
    return np.where(codes < EXACT, c, EXACT * 2.0 ** ((c - EXACT) / STEPS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ngram_keys(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The trigram that ends at each token: the bigram's hash, then bits of the first word's."""
    first = np.zeros(len(words), bool)
    first[np.cumsum(sizes) - sizes] = True
    v = np.concatenate([[START], words[:-1]]).astype(np.uint64)
    v[first] = START
    u = np.concatenate([[START], v[:-1]]).astype(np.uint64)
    u[first] = START
    shift = np.uint64(CHILD_BITS)
    return _mix(_mix(words) + v) >> shift << shift | _mix(u) >> np.uint64(64 - CHILD_BITS)


def text_blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, learn) as blocks: the documents' tokens as codes of the block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, made = TaskContext.get().partitionId(), count()

        def block(known, codes, sizes, ids, learn):
            codes, sizes = np.concatenate(codes), np.concatenate(sizes)
            hashes = np.concatenate([[END], np.fromiter(map(xxhash.xxh3_64_intdigest, list(known)[1:]), np.uint64, len(known) - 1)])
            words, place = np.unique(hashes, return_inverse=True)
            codes = place[codes].astype(np.uint32)
            sample = distinct(ngram_keys(words[codes], sizes)[SAMPLE_STEP // 2 :: SAMPLE_STEP])
            learn = pa.concat_arrays(learn)
            n_learn = int(sizes[learn.to_numpy(zero_copy_only=False)].sum())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(ids), learn, pa.array(sample.view(np.int64)))]
            raw = [pa.array([x], pa.binary()) for x in (sizes.astype("<i8").tobytes(), pack(words), squeeze(codes))]
            figures = [pa.array([x], pa.int64()) for x in ((part << 32) + next(made), len(words), len(codes), n_learn)]
            columns = [figures[0], *lists[:2], *raw, *figures[1:], lists[2]]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCK.split(", ")])

        def new():
            known = defaultdict(count(1).__next__)
            known[None] = 0  # the end
            return known, [], [], [], []

        held, size = new(), 0
        for batch in batches:
            for some in text_slices(batch, "text", rows=1 << 14, size=BLOCK_BYTES // 4):
                texts = some.column("text").to_pylist()
                own = sum(map(len, filter(None, texts)))
                if size and size + own > BLOCK_BYTES:
                    yield block(held[0], *held[1:])
                    held, size = new(), 0
                words = [[*(t or "").encode().lower().split(), None] for t in texts]
                held[1].append(np.fromiter(map(held[0].__getitem__, chain.from_iterable(words)), np.uint32, sum(map(len, words))))
                held[2].append(np.fromiter(map(len, words), np.int64, len(words)))
                held[3].append(some.column("doc_id"))
                held[4].append(some.column("learn"))
                size += own
        if held[1]:
            yield block(held[0], *held[1:])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("learn", F.lit(False)).alias("learn"))
    return rows.mapInArrow(run, BLOCK)


class Block:
    """A block's tokens, and what it asks of the shards. Its n-grams are kept in order of their keys:
    token `order[k]` ends the k-th."""

    def __init__(self, row: dict):
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.words, self.codes = EliasFano(row["words"]).all(), loose(row["codes"])
        self.learn = np.repeat(np.array(row["learn"], bool), self.sizes)

    def sort(self, borders: np.ndarray) -> None:
        keys = ngram_keys(self.words[self.codes], self.sizes)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        asked = self.keys[starts(self.keys)]
        # A bigram that a border cuts is asked for on both sides.
        shift = np.uint64(CHILD_BITS)
        heads = borders >> shift << shift
        at = np.searchsorted(asked, heads)
        has = (at < len(asked)) & (asked[np.minimum(at, len(asked) - 1)] >> shift == heads >> shift)
        self.asked = distinct(np.concatenate([asked, borders[has], heads[has]])) if has.any() else asked

    def requests(self, level: int, borders: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """(shard, keys, training counts) for every shard that the block has keys of."""
        if level == WORDS:
            keys, mine = self.words, self.codes[self.learn]
        else:
            self.sort(borders)
            keys, mine = self.asked, np.searchsorted(self.asked, self.keys[self.learn[self.order]])
        counts = np.bincount(mine, minlength=len(keys))
        cuts = np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]])
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[shard : shard + 2]
            yield shard, pack(keys[a:b]), squeeze(counts[a:b])


class TrieLevel:
    """Bigrams of a shard and their first words, mapped from one buffer."""

    def __init__(self, buffer):
        self.bigrams = EliasFano(buffer)
        self.pointers = EliasFano(buffer, self.bigrams.end)
        self.children = EliasFano(buffer, self.pointers.end)
        self.bigram_codes = np.frombuffer(buffer, np.uint16, self.bigrams.n, self.children.end)
        self.child_codes = np.frombuffer(buffer, np.uint16, self.children.n, self.children.end + 2 * self.bigrams.n)

    map = classmethod(lambda cls, buffer: cls(buffer))

    @staticmethod
    def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
        """keys: distinct and sorted; counts: above 0."""
        bigrams = keys >> np.uint64(CHILD_BITS)
        first = starts(bigrams)
        bigrams = bigrams[first]
        stop = np.append(first[1:], len(keys)).astype(np.int64)
        child = (keys & np.uint64((1 << CHILD_BITS) - 1)).astype(np.int64)
        # Children count on from the last one of the bigram before.
        ends = np.cumsum(child[stop - 1] + 1) if len(keys) else np.zeros(0, np.int64)
        base = np.concatenate([[0], ends])[:-1] if len(keys) else ends
        total = np.add.reduceat(counts, first) if len(keys) else counts
        parts = [pack(bigrams), pack(np.append(first, len(keys))), pack((child + np.repeat(base, stop - first)).astype(np.uint64))]
        return b"".join([*parts, coded(total).tobytes(), coded(counts).tobytes()])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the trigrams, codes of their distinct bigrams in order); 0 if unseen. keys: sorted."""
        asked = keys >> np.uint64(CHILD_BITS)
        first = starts(asked)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(asked))))
        asked = asked[first]
        if not self.bigrams.n:
            return np.zeros(len(keys), np.uint16), np.zeros(len(asked), np.uint16)
        at = self.bigrams.successor(asked)
        there = at < self.bigrams.n
        there[there] = self.bigrams.access(at[there]) == asked[there]
        at = np.where(there, at, 0)
        start, stop = self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)
        base = np.where(start > 0, self.children.access(np.maximum(start - 1, 0)) + np.uint64(1), 0).astype(np.uint64)
        wanted = base[of] + (keys & np.uint64((1 << CHILD_BITS) - 1))
        child = self.children.successor(wanted)
        seen = there[of] & (child < stop[of])
        seen[seen] = self.children.access(child[seen]) == wanted[seen]
        return np.where(seen, self.child_codes[np.where(seen, child, 0)], 0).astype(np.uint16), np.where(there, self.bigram_codes[at], 0).astype(np.uint16)


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys with their training counts, and the keys that each block asks for."""
    asked = [EliasFano(k.as_buffer()).all() for k in table.column("keys")]
    keys, n = np.concatenate(asked), np.concatenate([loose(c.as_py()) for c in table.column("counts")])
    keys, n = keys[n > 0], n[n > 0].astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = starts(keys)
    return keys[first], np.add.reduceat(n, first) if len(first) else n, asked


def _requests(blocks: DataFrame, level: int, borders: np.ndarray) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                found = list(Block(row).requests(level, borders))
                shard, keys, counts = zip(*found, strict=True)
                columns = [pa.array(shard, pa.int32()), pa.array([row["block"]] * len(shard), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "keys", "counts"])

    return blocks.select("block", "sizes", "learn", "words", "codes").mapInArrow(ask, "shard int, block bigint, keys binary, counts binary")


def _word_answers(table: pa.Table) -> pa.Table:
    words, n, asked = _summed(table)
    level, answers = EliasFano(pack(words)), []
    for x in asked:
        at = level.successor(x)
        seen = at < level.n
        seen[seen] = level.access(at[seen]) == x[seen]
        answers.append(pa.compress(np.where(seen, np.append(n, 0)[np.where(seen, at, -1)], 0).astype("<i8").tobytes(), codec="zstd", asbytes=True))
    return pa.table([table.column("block"), pa.array([WORDS] * len(asked), pa.int32()), table.column("shard"), pa.array(answers, pa.binary()), pa.array([len(words)] * len(asked), pa.int64())], names=["block", "level", "shard", "answer", "n_known"])


def _ngram_answers(table: pa.Table) -> pa.Table:
    keys, n, asked = _summed(table)
    level = TrieLevel.map(TrieLevel.pack(keys, n))
    answers = [squeeze(np.concatenate(level.find(x))) for x in asked]
    return pa.table([table.column("block"), pa.array([NGRAMS] * len(asked), pa.int32()), table.column("shard"), pa.array(answers, pa.binary()), pa.array([level.children.n] * len(asked), pa.int64())], names=["block", "level", "shard", "answer", "n_known"])


ANSWER = "block bigint, level int, shard int, answer binary, n_known bigint"
SCORES = "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(row: dict, answers: list[dict], borders: np.ndarray, word_shards: np.ndarray, n: int, v: int, k2: float, k3: float) -> pa.Table:
    b = Block(row)
    b.sort(borders)
    answers.sort(key=lambda a: (a["level"], a["shard"]))
    cuts = np.searchsorted(b.words, word_shards)
    counts = np.concatenate([np.frombuffer(pa.decompress(a["answer"], 8 * size, codec="zstd"), "<i8") for a, size in zip(
        (a for a in answers if a["level"] == WORDS), (s for s in np.diff(np.concatenate([[0], cuts, [len(b.words)]])).tolist() if s), strict=True)])
    trigrams, bigrams, names = [], [], []
    edges = np.concatenate([[0], np.searchsorted(b.asked, borders), [len(b.asked)]])
    for a in (a for a in answers if a["level"] == NGRAMS):
        keys = b.asked[edges[a["shard"]] : edges[a["shard"] + 1]]
        got = loose(a["answer"])
        trigrams.append(got[: len(keys)])
        bigrams.append(decoded(got[len(keys) :]))
        names.append(distinct(keys >> np.uint64(CHILD_BITS)))
    names, bigrams = np.concatenate(names), np.concatenate(bigrams)
    first = starts(names)
    names, bigrams = names[first], np.add.reduceat(bigrams, first)
    c3, c2 = np.empty(len(b.keys)), np.empty(len(b.keys))
    c3[b.order] = decoded(np.concatenate(trigrams))[np.searchsorted(b.asked, b.keys)]
    c2[b.order] = bigrams[np.searchsorted(names, b.keys >> np.uint64(CHILD_BITS))]
    c1 = counts[b.codes]
    heads = np.cumsum(b.sizes) - b.sizes
    ends = float(counts[np.searchsorted(b.words, END)])
    # Occurrences of the context: the token before; the bigram before.
    cv, cuv = np.append(0.0, c1[:-1]), np.append(0.0, c2[:-1])
    cv[heads] = cuv[heads] = ends
    p1 = (c1 + 1.0) / (n + v + 1.0)
    p2 = (c2 + k2 * p1) / (cv + k2)
    p3 = (c3 + k3 * p2) / (cuv + k3)
    figures = [np.add.reduceat(x, heads) for x in ((c1 > 0).astype(np.int64), np.log10(p1), np.log10(p3))]
    ids, learn = pa.array(row["doc_ids"], pa.int64()), pa.array(row["learn"], pa.bool_())
    columns = [ids, learn, pa.array(b.sizes), pa.array(figures[0]), pa.array([n] * len(ids), pa.int64()), pa.array(figures[1]), pa.array(figures[2])]
    return pa.table(columns, names=[c.split()[0] for c in SCORES.split(", ")])


def _even(n: int) -> np.ndarray:
    """Borders of n even ranges of 64-bit hashes."""
    return np.array([(k << 64) // n for k in range(1, n)], np.uint64)


def _borders(blocks: DataFrame, n: int) -> np.ndarray:
    """Borders of about n ranges of n-gram keys with as many of the sample each. What the driver gets
    is at most about SAMPLE numbers."""
    sample = blocks.select(F.explode("sample").alias("k"))
    total = blocks.agg(F.sum(F.size("sample"))).first()[0] or 0
    share = min(1.0, SAMPLE / max(total, 1))
    if n < 2 or not total:
        return _even(1)
    got = np.array([r["k"] for r in sample.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(share * (1 << 20))).collect()], np.int64).view(np.uint64)
    got.sort()
    return np.unique(got[np.arange(1, n) * len(got) // n]) if len(got) >= n else _even(n)


def score_corpus(docs: DataFrame, k2: float = K2, k3: float = K3, shard_keys: int | None = None) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id,
    text, learn); the model learns from the rows marked learn. Scores are log10 probabilities."""
    blocks = materialize(text_blocks(docs), "blocks")
    total = blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_learn")).first()
    per = SHARD_KEYS if shard_keys is None else shard_keys
    word_borders = _even(max(1, -(-(total[0] or 0) // per)))
    borders = _borders(blocks, max(1, -(-(total[1] or 0) // per)))
    n = total[2] or 0
    words = materialize(_requests(blocks, WORDS, word_borders).groupBy("shard").applyInArrow(_word_answers, ANSWER), "word-counts")
    v = words.groupBy("shard").agg(F.max("n_known").alias("v")).agg(F.sum("v")).first()[0] or 0
    ngrams = _requests(blocks, NGRAMS, borders).groupBy("shard").applyInArrow(_ngram_answers, ANSWER)

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        return _score(block.to_pylist()[0], answers.to_pylist(), borders, word_borders, n, v, k2, k3)

    own = blocks.select("block", "doc_ids", "learn", "sizes", "words", "codes")
    return own.groupBy("block").cogroup(words.union(ngrams).groupBy("block")).applyInArrow(score, SCORES)


def trie_shards(docs: DataFrame, shard_keys: int | None = None) -> DataFrame:
    """(shard, first_key, payload): the n-gram levels learnt from docs (doc_id, text, learn), each
    payload a buffer for TrieLevel.map."""
    blocks = materialize(text_blocks(docs), "blocks")
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    borders = _borders(blocks, max(1, -(-total // (SHARD_KEYS if shard_keys is None else shard_keys))))

    def build(table: pa.Table) -> pa.Table:
        keys, n, _ = _summed(table)
        first = keys[:1].view(np.int64) if len(keys) else np.zeros(1, np.int64)
        return pa.table([table.column("shard").slice(0, 1), pa.array(first), pa.array([TrieLevel.pack(keys, n)], pa.binary())], names=["shard", "first_key", "payload"])

    return _requests(blocks, NGRAMS, borders).groupBy("shard").applyInArrow(build, "shard int, first_key bigint, payload binary")

