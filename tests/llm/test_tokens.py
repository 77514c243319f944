import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from itemforge.llm import pieces, queries, separators, wavelet
from itemforge.llm.bpe_cache import ChunkedEncoder, KnownChunks

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def noise(n, seed, size=14):
    rng = random.Random(seed)
    marks = [*" \n\t\0ab'sé1,.<|▁漢\x1c\x85\xa0", "<|endoftext|>", " the", "'ll", "  ", " " * 17, "<0x0A>", "</s>", "="]
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(size))) for _ in range(n)]


def listed(encoded):
    ids, sizes = encoded
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_chunked_encoding_is_the_library(library, documents):
    texts = noise(4000, 1) + [r.text for r in documents.limit(40).collect()]
    enc = ChunkedEncoder(VOCAB, cache_bytes=100_000)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        assert listed(enc.encode(pa.array(part))) == library(part)


def test_chunked_encoding_is_the_default_library(documents):
    plain = Tokenizer.from_file(VOCAB)
    mark = "<|endoftext|>"
    texts = [*noise(4000, 5), f"a{mark}b", mark, f" {mark} ", f"{mark}{mark}\n{mark}", f"the {mark}\n\n x", "<|endof text|>", "<|endoftext|", f"\0{mark}"]
    texts += [r.text[:50] + mark + r.text[50:] for r in documents.limit(40).collect() if r.text]
    enc = ChunkedEncoder(VOCAB, cache_bytes=100_000, special_as_text=False)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        assert listed(enc.encode(pa.array(part))) == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]


def test_chunks_are_learnt_once():
    """60,000 words fit 6 MB with their ids, and marks behind a word don't make it another one."""

    class Counted:
        def __init__(self, inner):
            self.inner, self.n = inner, 0

        def encode_batch_fast(self, texts, **options):
            self.n += sum(1 + t.count("\x01") for t in texts)
            return self.inner.encode_batch_fast(texts, **options)

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("aeiounrst") for _ in range(9)) for _ in range(60_000)})
    enc = ChunkedEncoder(VOCAB, cache_bytes=6 << 20)
    enc.pieces = Counted(enc.pieces)
    slices = [words[at : at + 4000] for at in range(0, len(words), 4000)]
    want = [listed(enc.encode(pa.array([": " + " ".join(part)])))[0] for part in slices]
    assert enc.pieces.n == len(words)
    assert [listed(enc.encode(pa.array([": " + " ".join(part)])))[0] for part in slices] == want
    for mark in (",", ".", "!?"):
        enc.encode(pa.array([": " + f"{mark} ".join(words[:4000])]))
    assert enc.pieces.n == len(words)


def test_chunks_met_again_stay():
    """When the cache is full, words that come again and again outlast those that came once."""
    enc = ChunkedEncoder(VOCAB, cache_bytes=400_000)
    often = " ".join(f"often{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")
    for k in range(40):
        once = " ".join(f"once{'abcdefghij'[k % 10]}{'klmn'[k // 10]}{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "uvwxyzabcd")
        enc.encode(pa.array([once] if k % 2 else [f"x {often}", once]))
        assert enc.known.held < 500_000
    calls = []
    inner, enc.pieces = enc.pieces, type("Noted", (), {"encode_batch_fast": lambda self, texts, **o: calls.append(texts) or inner.encode_batch_fast(texts, **o)})()
    enc.encode(pa.array([f"x {often}"]))
    assert not calls


def test_chunks_with_one_hash_stay_apart(library, monkeypatch):
    keyed = KnownChunks.keyed

    def clashing(chunks):
        keys, hashes, long = keyed(chunks)
        return keys, hashes % np.uint64(7), long

    monkeypatch.setattr(KnownChunks, "keyed", staticmethod(clashing))
    texts = noise(2000, 6)
    enc = ChunkedEncoder(VOCAB, cache_bytes=100_000)
    for at in range(0, len(texts), 300):
        assert listed(enc.encode(pa.array(texts[at : at + 300]))) == library(texts[at : at + 300])


def test_token_output_query_is_the_default_library(spark, odd, tmp_path):
    plain = Tokenizer.from_file(VOCAB)
    more = spark.createDataFrame([(20, "a<|endoftext|>b"), (21, "after it"), (22, "<|endoftext|>")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    got = sorted(queries.op4_token_output(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    start = 0
    for r, ((known, i), t) in zip(got, rows, strict=True):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += r.n_tokens
    # The same worker's other encoder keeps the text: there the id is the separator.
    counts = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, str(tmp_path)).collect()}
    assert (counts[20], counts[21]) == (9, len(plain.encode("after it").ids))


def test_flat_rows_are_made_in_little_memory(documents):
    """Many texts of one batch are encoded in small slices."""
    texts = [r.text for r in documents.limit(400).collect() if r.text]
    texts = (texts * (1 + (12 << 20) // sum(map(len, texts))))[: 1 << 14]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    separators.encoder(VOCAB, special_as_text=True, cache_bytes=separators.CACHE_BYTES)
    tracemalloc.start()
    try:
        n = sum(r.column("n")[0].as_py() for r in separators.flat_rows(iter([batch]), 0, VOCAB, 50256, 1 << 18, "<u2") if r.column("kind")[0].as_py() == "docs")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(texts) and peak < 64 << 20


def test_pieces_are_the_library(documents):
    table, sp = pieces.PrefixTable(MODEL, cache_bytes=100_000), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = noise(4000, 2) + [r.text for r in documents.limit(40).collect()] + ["a" * k for k in range(40)] + ["", "=" * 70]
    ids = [np.frombuffer(x, "<i4").tolist() for x in table.encode(texts)]
    assert ids == sp.encode(texts)
    ends = np.cumsum([len(x) for x in ids])
    assert [x.decode() for x in table.decode(np.array(sum(ids, []), np.int64), ends)] == sp.decode(ids)
    loose = [[3 + 0xE6], [3 + 0xE6, 3 + 0xBC], [1, 2], [28705, 28705], [3 + 65, 3 + 0xFF, 3 + 66], []]
    got = table.decode(np.array(sum(loose, []), np.int64), np.cumsum([len(x) for x in loose]))
    assert [x.decode() for x in got] == [sp.decode(x) for x in loose]


def test_pieces_dataframe(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.encode(odd, MODEL, decoded="decoded").collect()
    assert len(rows) == odd.count()
    texts = sorted((r.doc_id or 0, r.text or "") for r in odd.select("doc_id", "text").collect())
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows)
    assert [(i, x) for i, x, _ in got] == [(i, sp.encode(t)) for i, t in texts]
    assert [d for _, _, d in got] == [sp.decode(sp.encode(t)) for _, t in texts]
    again = pieces.decode(pieces.encode(odd, MODEL), MODEL).select("doc_id", "decoded")
    assert sorted((r.doc_id or 0, r.decoded) for r in again.collect()) == [(i, d) for i, _, d in got]
    assert pieces.encode(odd.limit(0), MODEL).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 511, 512, 3000):
        ids = rng.integers(0, 300, n).astype(np.uint16)
        w = wavelet.WaveletMatrix(wavelet.pack([5], ids, np.array([n]), 16)[1])
        assert (w.all() == ids).all()
        for i in rng.integers(0, n, 20).tolist():
            token = int(ids[i])
            assert w.access(i) == token
            assert w.count(token, 0, i) == int((ids[:i] == token).sum())
            assert w.locate(token, w.count(token, 0, i)) == i
        assert w.count(60000) == 0
        with pytest.raises(IndexError):
            w.locate(60000, 0)


def test_wavelet_round_trip(odd, library, monkeypatch):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in odd.select("doc_id", "text").collect())
    got = sorted(wavelet.token_output(odd, VOCAB, shards=3).collect(), key=lambda r: r.start)
    ids = {t: [*x, 2] for t, x in zip([t for _, t in rows], library([t for _, t in rows]), strict=True)}
    assert [r.doc_id for r in got] == [i if known else None for (known, i), _ in rows]
    start = 0
    for r, (_, t) in zip(got, rows, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes()))
        start += r.n_tokens
    assert wavelet.token_output(odd.limit(0), VOCAB, shards=3).count() == 0


def test_wavelet_small_blocks(spark, documents, tmp_path):
    path = str(tmp_path / "w")
    wavelet.write_shards(documents, path, VOCAB, 4, 2, block_tokens=500)
    small = wavelet.read_documents(spark, path).orderBy("doc_id").collect()
    assert small == wavelet.token_output(documents, VOCAB, shards=1).orderBy("doc_id").collect()
    assert spark.read.parquet(path).count() > 20


def test_shards_of_several_blocks(spark, documents, tmp_path):
    path = str(tmp_path / "w")
    wavelet.write_shards(documents.limit(60), path, VOCAB, 2, 2, block_tokens=500)
    shards: dict = {}
    for r in spark.read.parquet(path).orderBy("shard", "block").collect():
        shards.setdefault(r.shard, []).append(wavelet.WaveletMatrix(r.payload).all().astype(np.int64))
    assert all(len(b) > 2 for b in shards.values())
    ids = {s: np.concatenate(b) for s, b in shards.items()}
    for token in (2, 11, 60000):
        where = {s: np.flatnonzero(x == token) for s, x in ids.items()}
        assert {r.shard: r.n for r in wavelet.shard_count(spark, path, token).collect()} == {s: len(w) for s, w in where.items()}
        for k in (0, 17, 10**6):
            got = {r.shard: r.position for r in wavelet.shard_locate(spark, path, token, k).collect()}
            assert got == {s: w[k] for s, w in where.items() if k < len(w)}
    asked = [(s, p) for s, x in ids.items() for p in (0, 499, len(x) // 2, len(x) - 1)]
    rows = spark.createDataFrame([*asked, (0, -1), (0, 10**9)], "shard int, position long")
    got = {(r.shard, r.position): r.token for r in wavelet.shard_access(rows, path).collect()}
    assert got == {(s, p): ids[s][p] for s, p in asked}


@pytest.mark.parametrize("block_ids", [1, 7, 1 << 18])
def test_token_counts(odd, library, block_ids):
    few = odd.where("doc_id is null or doc_id <> 6") if block_ids == 1 else odd
    want = sorted((r.doc_id or 0, n) for r, n in ((r, len(library([r.text])[0])) for r in few.select("doc_id", "text").collect()))
    got = separators.token_counts(few.repartition(2), VOCAB, block_ids=block_ids)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == want


def test_scan_flat_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = []
    for name in ("a", "b", "empty"):
        ids = np.zeros(0, "<u4") if name == "empty" else rng.integers(0, 4, 200).astype("<u4")
        ids.tofile(tmp_path / f"{name}.bin")
        cuts = np.flatnonzero(ids == 0)
        sizes = np.diff(np.concatenate([[-1], cuts])) - 1
        want += [(name, k, int(n), True) for k, n in enumerate(sizes)]
        if len(ids) and ids[-1] != 0:
            want.append((name, len(cuts), int(len(ids) - cuts[-1] - 1), False))
    for size in (1, 3, 64, 1000):
        found = separators.scan_blocks(separators.flat_blocks(spark, str(tmp_path / "*.bin"), size), 0)
        assert sorted((r.file.rsplit("/", 1)[1][:-4], r.ordinal, r.n_tokens, r.ended) for r in found.collect()) == sorted(want)


def test_held_one_at_a_time():
    from itemforge.llm import common

    common.release()
    built = []
    for key in ("a", "a", "b", "a"):
        assert common.held(key, lambda key=key: built.append(key) or [key]) == [key]
    assert built == ["a", "b", "a"] and len(common._held) == 1
    common.release()
    assert not common._held
