import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from itemforge.llm import near_dup, positional_index, queries, quality, secrets


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(400)]
    rows, k = [], 0
    for size in (9, 15, 60, 200):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(14):
            copy = [w.upper() if rng.random() < 0.05 else rng.choice(words) if rng.random() < 0.015 else w for w in base]
            rows.append((k := k + 1, rng.choice([" ", "\n", "\t"]).join(copy)))
    return [*rows, (900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one two"), (907, "x " * 30_000)]


@pytest.mark.parametrize(("k", "percent", "tile"), [(3, 85, 128), (5, 80, 3), (3, 60, 2)])
def test_near_components(spark, monkeypatch, k, percent, tile):
    monkeypatch.setattr(near_dup, "TILE", tile)
    rows = near_copies(k)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_components(df, k, percent).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_components(rows, k, percent).items()}


def test_near_components_odd(odd):
    rows = near_dup.near_components(odd, 3, 85).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 5)} == {1}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)]
    assert near_dup.near_components(odd.limit(0)).count() == 0


def test_near_components_of_rows_without_own_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (3, b), (None, a), (None, a + " end"), (None, c), (None, c), (2, b), (7, a), (7, a), (8, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dup.near_components(df, 3, 85).collect())
    want = [(3, 38, 3, True), (3, 38, 2, False), (None, 38, 3, False), (None, 39, 3, False), (None, 38, None, False), (None, 38, None, False), (2, 38, 2, True), (7, 38, 3, False), (7, 38, 3, False), (8, 0, 8, True), (None, 0, None, False)]
    assert got == sorted((str(i), n, str(c), k) for i, n, c, k in want)
    stay = corpus_pipeline.near_dedup(spark, df.withColumn("row", F.monotonically_increasing_id()), "").collect()
    assert sorted((str(r.doc_id), str(r.text)[:2]) for r in stay) == sorted([("3", "a0"), ("2", "b0"), ("None", "c0"), ("8", "No"), ("None", "No")])


def test_tiles_compared_together():
    """A tile of many near copies in components of their own is a few products, not a comparison a pair."""
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 5000, 400).astype(np.uint64) << np.uint64(50)) for _ in range(20)] + [np.zeros(0, np.uint64)]
    assert near_dup.shared(sets[:8], sets[8:]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]
    base, rows = draw.integers(0, 1 << 63, 300).astype(np.uint64), []
    for k in range(120):
        own = np.unique(np.append(draw.choice(base, 285, replace=False), draw.integers(0, 1 << 63, 30).astype(np.uint64)))
        rows.append((0, k % 60 + 60 * (k >= 60), len(own), near_dup.sketches(near_dup.minhash(own)[None])[0], own.view(np.int64)))
    calls = []
    similar, near_dup.similar = near_dup.similar, lambda *x: calls.append(x) or similar(*x)
    try:
        pdf = pd.DataFrame([(side, rep, n, sketch, fp, rep) for _, rep, n, sketch, fp in rows for side in (0, 1)], columns=["side", "rep", "n", "sketch", "fp", "comp"])
        together = near_dup._tile_links(70, 512)(None, pdf)
        assert not calls
        near_dup.FEW_PAIRS, few = 1 << 30, near_dup.FEW_PAIRS
        alone = near_dup._tile_links(70, 512)(None, pdf)
        near_dup.FEW_PAIRS = few
        assert calls and len(together) > 60
        assert together.values.tolist() == alone.values.tolist()
    finally:
        near_dup.similar = similar


def test_near_components_query(spark, sf, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_minhash_dedup(spark, sf).collect()}
    assert got == brute_components(rows, 3, 85)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(8)
    for share in (0.8, 0.9, 0.97):
        shared, own = rng.integers(0, 1 << 63, 2000, np.uint64), rng.integers(0, 1 << 63, (2, int(1000 * (1 - share) / share)), np.uint64)
        samples = np.stack([near_dup.minhash(np.concatenate([shared, o])) for o in own])
        s = near_dup.sketches(samples).view(np.uint64)
        apart = int(np.bitwise_count(s[0] ^ s[1]).sum())
        j = 2000 / (2000 + 2 * own.shape[1])
        est = 1 + near_dup.SKETCH_BITS / (4 * near_dup.SAMPLES) * np.log(1 - 2 * apart / near_dup.SKETCH_BITS)
        assert abs(est - j) < 0.12 and apart <= near_dup.most_different(j)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(positional_index.UPPER, positional_index.LOWER)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(docs, items, width):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [positional_index.BROADCAST_BYTES, 0])
def test_decontaminate(spark, monkeypatch, limit):
    monkeypatch.setattr(positional_index, "BROADCAST_BYTES", limit)
    rng = random.Random(9)
    vocabulary = ["a", "b", "É", "é", "The", "the", "c1"]
    docs = [(k, "-".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "... --"), (503, "the " * 3000), (None, "x the the the the the y"), (None, "x the y"), (None, None), (7, "the the the the the"), (7, "c1")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 7)))) for k in range(25)] + [(90, None), (91, "!"), (92, "zzz a b c"), (3, "the the the the the")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in positional_index.decontaminate(d, b, width=4).collect()), key=repr)
    assert got == brute_hits(docs, items, 4)
    assert positional_index.decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in positional_index.decontaminate(d, b.limit(0)).collect()} == {0}


def test_decontaminate_odd(spark, odd):
    b = spark.createDataFrame([(1, "Second line of text")], "item_id long, text string")
    leaky = odd.unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r.n_hit for r in positional_index.decontaminate(leaky, b).where("doc_id is null").collect()) == [0, 4]
    kept = positional_index.decontaminate(leaky, b)
    assert kept.count() == leaky.count()
    got = {(r.doc_id, r.n_hit) for r in positional_index.decontaminate(odd, b).collect()}
    assert got == {(1, 4), (2, 0), (3, 0), (4, 0), (5, 4), (6, 0), (7, 0), (8, 0), (None, 0)}


def test_index_queries(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "cat the sat"), (3, "sat the cat near")], "doc_id long, text string")
    index = positional_index.postings(docs)
    assert index.count() == 13
    assert {tuple(r) for r in positional_index.phrase_matches(index, ["the", "cat"]).collect()} == {(1, 0), (3, 1)}
    near = positional_index.proximity_matches(index, ["cat", "sat"], 1)
    assert {tuple(r) for r in near.collect()} == {(1, 1)}
    assert {tuple(r) for r in positional_index.proximity_matches(index, ["cat", "sat"], 2).collect()} == {(1, 1), (2, 0), (3, 2)}


def test_pipeline(spark, sf, documents):
    """Every stage against a brute-force reading of what its operator promises."""
    docs, columns = documents, documents.columns
    stages = dict(corpus_pipeline.STAGES)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    scores, _, _ = quality.score_texts(model, [r.text or "" for r in rows.values()])
    want = {i for i, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD}
    for name in ("quality", "near_dedup", "decontaminate", "secrets"):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stages[name](spark, docs, sf).cache()
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "near_dedup":
            parts = brute_components([(i, r.text) for i, r in before.items()], 5, 80)
            want = {i for i, (_, c) in parts.items() if c == i}
        if name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            want = {i for i, _, hit, _ in brute_hits([(i, r.text) for i, r in before.items()], items, 10) if not hit}
        assert after.keys() == want
        for i, r in after.items():
            if name != "secrets" or not secrets.scan_one(before[i].text):
                assert r == before[i]
            else:
                assert "[REDACTED]" in r.text and r.n_chars == len(r.text)
    out = stages["encode"](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == want and all(r.n_tokens == len(r.ids) for r in out)
    assert {r.doc_id: r.decoded for r in out} == {r.doc_id: r.text for r in docs.collect()}
    full = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, full.select("doc_id", "n_tokens").collect())) == sorted((r.doc_id, r.n_tokens) for r in out)


def test_pipeline_odd_rows(spark, odd, sf):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where(F.col("doc_id").isNull()).count() == 1
    few = odd.where("doc_id in (1, 5)")  # three rows with one text, two of them equal
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, few, sf).collect()] == [1]
    assert corpus_pipeline.near_dedup(spark, few.where("doc_id = 5"), sf).count() == 1


def test_pipeline_empty(spark, documents, sf):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_decontaminate_stage_goes_by_text(spark, sf):
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, leak), (1, "a clean text"), (None, "so " + leak), (None, "clean, too")], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()) == ["a clean text", "clean, too"]
