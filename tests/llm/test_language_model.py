import math
import mmap
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemforge.llm import elias_fano, language_model, queries
from itemforge.llm.elias_fano import EliasFano

TOP = (1 << 64) - 1


@pytest.mark.parametrize("n", [0, 1, 2, 64, 1000, 70_000])
@pytest.mark.parametrize("top", [0, 1, 1000, 1 << 44, TOP])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = EliasFano(b"x" * 8 + elias_fano.pack(v), 8)
    assert (e.all() == v).all()
    i = rng.integers(0, n, 50) if n else np.zeros(0, np.int64)
    assert (e.access(i) == v[i]).all()
    x = np.concatenate([rng.integers(0, top, 60, dtype=np.uint64, endpoint=True), v[:50], v[:50] + np.uint64(1), np.array([0, TOP], np.uint64)])
    assert (e.successor(x) == np.searchsorted(v, x)).all()
    few = (v % np.uint64(1 << 31)).astype(np.uint32)
    assert (elias_fano.loose(elias_fano.squeeze(few)) == few).all()


def test_codes():
    c = np.array([0, 1, 32767, 32768, 10**6, 10**13])
    got = language_model.decoded(language_model.coded(c))
    assert (got[:4] == c[:4]).all() and (got <= c).all() and (got[1:] / c[1:] > 1 - 7e-4).all()


def test_trie_level_from_a_mapped_file(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 500, 4000, dtype=np.uint64) << np.uint64(18) | rng.integers(0, 1 << 18, 4000, dtype=np.uint64) % np.uint64(40))
    counts = rng.integers(1, 9, len(keys))
    (tmp_path / "level").write_bytes(language_model.TrieLevel.pack(keys, counts))
    with open(tmp_path / "level", "rb") as f:
        level = language_model.TrieLevel.map(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    asked = np.unique(np.concatenate([keys, rng.integers(0, 600 << 18, 3000, dtype=np.uint64), keys + np.uint64(1)]))
    tri, bi = level.find(asked)
    known = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    total = Counter()
    for k, n in known.items():
        total[k >> 18] += n
    assert tri.tolist() == [known.get(k, 0) for k in asked.tolist()]
    assert bi.tolist() == [total[k] for k in sorted({k >> 18 for k in asked.tolist()})]
    none = language_model.TrieLevel.map(language_model.TrieLevel.pack(keys[:0], counts[:0]))
    assert not none.find(asked)[0].any() and len(none.find(asked)[1]) == len(bi)


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + ["</end>"]


def brute(rows, k2=language_model.K2, k3=language_model.K3):
    """rows: (doc_id, text, learn) in any order."""
    one, two, three = Counter(), Counter(), Counter()
    for _, t, learn in rows:
        w = ["<s>", "<s>", *tokens(t)]
        if learn:
            one.update(w[2:])
            two.update(zip(w[1:], w[2:], strict=False))
            two["<s>", "<s>"] += 1
            three.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(one.values()), len(one)
    one["<s>"] = one["</end>"]
    out = []
    for i, t, learn in rows:
        w = ["<s>", "<s>", *tokens(t)]
        base = score = 0.0
        for k in range(2, len(w)):
            p = (one[w[k]] + 1) / (n + v + 1)
            base += math.log10(p)
            p = (two[w[k - 1], w[k]] + k2 * p) / (one[w[k - 1]] + k2)
            score += math.log10((three[w[k - 2], w[k - 1], w[k]] + k3 * p) / (two[w[k - 2], w[k - 1]] + k3))
        out.append((i, bool(learn), len(w) - 2, sum(one[x] > 0 for x in w[2:]), n, base, score))
    return out


def same(got, want, rel_tol=1e-7):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if not math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) or not math.isclose(g[6], w[6], rel_tol=rel_tol, abs_tol=rel_tol)]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize(("block", "shard", "step"), [(8 << 20, 1 << 19, 1 << 12), (2000, 300, 4), (100_000, 50, 1)])
def test_scores_are_brute_force(spark, odd, documents, monkeypatch, block, shard, step):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", block)
    monkeypatch.setattr(language_model, "SAMPLE_STEP", step)
    monkeypatch.setattr(language_model, "SAMPLE", 2000)
    rng = random.Random(1)
    # A bigram with many different words before it lies in several shards.
    hot = spark.createDataFrame([(100 + k, " ".join(f"w{rng.randrange(400)} a b" for _ in range(60)), k % 3 > 0) for k in range(8)], "doc_id long, text string, learn boolean")
    docs = odd.select("doc_id", "text").union(documents.limit(20 if step == 1 else 60).select("doc_id", "text"))
    docs = docs.withColumn("learn", F.col("doc_id") % 7 != 2).union(hot)
    rows = [tuple(r) for r in docs.collect()]
    got = language_model.score_corpus(docs.repartition(3), shard_keys=shard).collect()
    same(got, brute([(i, t, bool(learn)) for i, t, learn in rows]))
    if step == 1:
        shards = language_model.trie_shards(docs, shard).collect()
        assert len(shards) > 10 and sum(language_model.TrieLevel.map(r.payload).children.n for r in shards) > 500


def test_probabilities_sum_to_one():
    """Over the words and one unknown word, whatever was learnt."""
    rows = [(1, "a b a b c", True), (2, "a b d", True), (3, "c a", True)]
    words = [*sorted({w for _, t, _ in rows for w in tokens(t)[:-1]}), "unknown", ""]
    for context in ("", "a ", "a b ", "x y "):
        asked = [(10 + k, context + w, False) for k, w in enumerate(words)]
        # The text context + w + end, less w's end; the empty word stands for the end itself.
        found = {r[0]: r[6] for r in brute(rows + asked)}
        ended = {10 + k: _last(rows, context + w) if w else 0.0 for k, w in enumerate(words)}
        before = _all_but_last(rows, context)
        total = sum(10 ** (found[10 + k] - ended[10 + k] - before) for k in range(len(words)))
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def _last(rows, text):
    """log10 probability of the end after the text."""
    return next(r for r in brute([*rows, (0, text, False)]) if r[0] == 0)[6] - _all_but_last(rows, text)


def _all_but_last(rows, text):
    one, two, three = Counter(), Counter(), Counter()
    for _, t, _ in rows:
        w = ["<s>", "<s>", *tokens(t)]
        one.update(w[2:])
        two.update(zip(w[1:], w[2:], strict=False))
        two["<s>", "<s>"] += 1
        three.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(one.values()), len(one)
    one["<s>"] = one["</end>"]
    w, total = ["<s>", "<s>", *tokens(text)[:-1]], 0.0
    for k in range(2, len(w)):
        p = (one[w[k]] + 1) / (n + v + 1)
        p = (two[w[k - 1], w[k]] + language_model.K2 * p) / (one[w[k - 1]] + language_model.K2)
        total += math.log10((three[w[k - 2], w[k - 1], w[k]] + language_model.K3 * p) / (two[w[k - 2], w[k - 1]] + language_model.K3))
    return total


def test_query(spark, sf, documents):
    got = queries.op12_lm_scoring(spark, sf)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(r.doc_id, r.text, not held(r.doc_id)) for r in documents.collect()]
    found = got.collect()
    same([(r.doc_id, not r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found], brute(rows))
    # Unseen texts are likelier by the trie than by single words.
    assert sum(r.score - r.base_score for r in found if r.held_out) > 0


def test_empty_and_unlearnt(spark, odd):
    docs = odd.select("doc_id", "text", F.lit(None).cast("boolean").alias("learn"))
    assert language_model.score_corpus(docs.limit(0)).count() == 0
    got = language_model.score_corpus(docs).collect()
    assert len(got) == odd.count() and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
    assert language_model.trie_shards(docs.limit(0)).count() == 0
