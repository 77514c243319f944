import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from itemforge.llm import resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, percent, min_words, buckets, longest, seed):
    found = [(i, *features(t, longest)) for i, t in docs]
    s, t = Counter(h % buckets for _, _, f in found for h in f), Counter(h % buckets for x in target for h in features(x, longest)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[h % buckets] for h in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = len(able) * percent // 100
    ranks = [k + 1 if k < drawn else None for k in range(len(able))]
    return [(r[0], *r[2:], k) for r, k in zip(able, ranks, strict=True)] + [(r[0], *r[2:], None) for r in rows if r[1] < min_words]


@pytest.mark.parametrize(("buckets", "longest", "percent", "min_words"), [(10_000, 1, 10, 20), (7, 3, 50, 2), (65_536, 2, 100, 0), (1, 1, 0, 1)])
def test_resample_is_brute_force(spark, odd, documents, sf, monkeypatch, buckets, longest, percent, min_words):
    monkeypatch.setattr(resample, "STREAM_BYTES", 3000)
    docs = odd.union(odd.limit(0)).select("doc_id", "text").union(documents.limit(40).select("doc_id", "text"))
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    got = resample.resample(docs.repartition(3), target, percent, min_words, buckets, longest, seed=7).collect()
    want = brute(rows, [r.text for r in target.collect()], percent, min_words, buckets, longest, 7)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_resample_empty_tables(spark, odd):
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    empty = resample.resample(odd.limit(0), odd)
    assert empty.columns == names and empty.count() == 0
    # Without a target, words that the corpus has often count the least.
    got = resample.resample(odd, odd.limit(0), percent=100, min_words=0)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, odd.count() + 1))


def test_counts_and_gains(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "B")], "doc_id long, text string").repartition(2)
    streams = resample.bucket_streams(docs, buckets=50_000)
    bucket = {w: zlib.crc32(w) % 50_000 for w in (b"a", b"b")}
    assert {r.bucket: r.n for r in resample.bucket_counts(streams).collect()} == {bucket[b"a"]: 2, bucket[b"b"]: 2}
    gains = np.zeros(50_000, np.int64)
    gains[[bucket[b"a"], bucket[b"b"]]] = 10, -1
    assert sorted(map(tuple, resample.weights(streams, gains).collect())) == [(1, 3, 3, 19), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 1, -1)]
    assert resample.bucket_gains(np.array([0, 9]), np.array([9, 0])).tolist() == [2302, -2303]
    with pytest.raises(ValueError):
        resample.bucket_streams(docs, buckets=1 << 17)
