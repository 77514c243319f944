import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemforge.llm import metric_join, queries, sharding
from itemforge.llm.common import connected_components


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 199)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100, 199: 199, 200: 199}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shard_sizes(spark, odd, documents):
    for df in (odd, documents, documents.limit(5)):
        rows = sharding.shard(df, 7).collect()
        assert len(rows) == df.count()
        sizes = Counter(r.shard for r in rows)
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(7)) <= 1
        for s, n in sizes.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert sharding.shard(documents.limit(0), 7).count() == 0


def test_shard_is_repeatable_and_uniform(spark):
    df = spark.range(4000)
    one, two = ({r.id: (r.shard, r.slot) for r in sharding.shard(d, 8).collect()} for d in (df, df.repartition(5)))
    assert one == two
    seen = Counter(s for i, (s, _) in one.items() if i < 800)
    assert all(abs(seen[s] - 100) < 50 for s in range(8))
    slots = np.array([one[i][1] for i in range(4000)])
    assert abs(np.corrcoef(np.arange(4000), slots)[0, 1]) < 0.06


def test_shard_query_by_brute_force(spark, sf, documents):
    rows = {r.doc_id: r for r in queries.op5_sharding(spark, sf).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in documents.select("doc_id", "text").collect()}
    assert {i: (r["size"], r.text_crc32) for i, r in rows.items()} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in rows.values()} == {("rows", None)}
    slots = {}
    for r in rows.values():
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(x) for x in slots.values()]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1


def test_shard_keeps_any_column(spark):
    df = spark.createDataFrame([(k, "keep-me", {"a": k}) for k in range(50)], "id long, v string, m map<string,long>")
    df = df.select("id", "m", *(F.concat("v", F.col("id").cast("string")).alias(n) for n in ("__a", "__b", "__p", "__i", "__g", "a", "b", "p", "i", "g", "c0", "row", "upto", "base", "n", "j")))
    rows = sharding.shard(df, 4).collect()
    assert sorted(r.id for r in rows) == list(range(50))
    assert all(r[n] == f"keep-me{r.id}" for r in rows for n in df.columns[2:]) and all(r.m == {"a": r.id} for r in rows)


def test_draws_beyond_the_library_bound():
    rng = np.random.default_rng(4)
    good, bad, take = 3_000_000_000, 5_000_000_000, 400
    x = np.array([sharding._draw(rng, good, bad, take) for _ in range(4000)])
    mean, var = take * 0.375, take * 0.375 * 0.625
    assert abs(x.mean() - mean) < 5 * (var / 4000) ** 0.5 and abs(x.var() / var - 1) < 0.12
    # The same inversion on a small population, against the exact law.
    small = np.array([sharding.by_inversion(rng, 7, 9, 6) for _ in range(6000)])
    law = [math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6) for k in range(7)]
    assert np.allclose(np.bincount(small, minlength=7) / 6000, law, atol=0.03)
    assert sharding.communication_matrix([2_000_000_000, 3_000_000_001], 3, 1).sum() == 5_000_000_001


def test_communication_matrix():
    m = sharding.communication_matrix([10, 0, 25, 6], 4, 3)
    assert m.sum(1).tolist() == [10, 0, 25, 6] and m.sum(0).tolist() == [11, 10, 10, 10] and (m >= 0).all()
    mean = np.mean([sharding.communication_matrix([10, 30], 4, s)[0] for s in range(400)], axis=0)
    assert np.allclose(mean, 2.5, atol=0.25)


def brute(rows, cosine):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    root[max(p, q)] = min(p, q)
    return {r[0]: (links[r[0]], find(r[0])) for r in rows}


@pytest.mark.parametrize("tile", [4, 1024])
def test_metric_join(spark, monkeypatch, tile):
    monkeypatch.setattr(metric_join, "TILE", tile)
    monkeypatch.setattr(metric_join, "ROWS_PER_PIVOT", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(k, (centres[k % 12] + rng.normal(size=6) * rng.choice([0.02, 0.1, 0.4])).astype(np.float32).tolist(), int(k % 12 > 5)) for k in range(160)]
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(9)]  # equal vectors
    rows += [(300, None, 1), (301, [0.0] * 6, 1), (302, [float("nan")] * 6, 1), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (304, rows[1][1], None), (305, [float("inf")] * 6, 0), (306, [1.0, 2.0], 0), (307, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_components(df, 0.98).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, 0.98).items()}
    assert metric_join.near_components(df.limit(0), 0.98).count() == 0


def test_metric_join_of_many_labels_stays_off_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(3 * k + j, (np.eye(4)[k % 4] + 0.05 * j * rng.normal(size=4)).tolist(), k) for k in range(150) for j in range(2)]
    rows += [(1000 + k, rng.normal(size=4).tolist(), 500) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(metric_join, "ROWS_PER_PIVOT", 20)
    met, collect = [], type(df).collect

    def counted(self):
        found = collect(self)
        met.append(len(found))
        return found

    monkeypatch.setattr(type(df), "collect", counted)
    pivots = metric_join.draw_pivots(df.withColumnRenamed("vec_id", "row"))
    out = metric_join.near_components(df, 0.98)
    monkeypatch.undo()
    assert max(met, default=0) < 20
    assert [r.label for r in pivots.collect()] == [500]
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert got == brute(rows, 0.98)
