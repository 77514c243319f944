"""MinHash near-dedup (operator 9) with odd sketches.

Words are runs of non-space bytes with A-Z lower-cased; a text's set holds its distinct k-word
shingles as 64-bit fingerprints. Texts with equal sets are one class, represented by its smallest
id. MinHash samples of a class give band keys (candidates), and are folded into an odd sketch: a
parity bitmap in which each sample flips one bit. The population count of two sketches' XOR
estimates a high similarity; candidates whose estimate is far below the threshold are dropped, the
others are confirmed on the full sets.

No bucket is expanded into its pairs. First every member is compared with a few of the bucket's classes,
the same ones in all its bands as far as they are there (its hubs). In buckets whose members still lie in more than one component, the classes outside
the largest component meet all of the bucket's classes, cut into tiles of about TILE whose pairs are
compared in tasks of their own; within a task only links that join two components are kept. So a
bucket of n members costs HUBS * n rows, and more only where comparisons are really open; nothing is capped.

Null and empty texts, and texts of white space, have an empty set and link with nothing; a text
with fewer than k words has its whole sequence as one shingle. Rows with a null id take part in all
of this: they get the smallest id of their component, null if it has none, and kept false. Rows that
share an id but not a text are compared each for itself; equal rows are one. Very long texts have
their whole sets. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import codepoints as cp
from itemforge.llm.common import connected_components, drop, materialize, release, text_slices

SAMPLES = 125
SKETCH_BITS = 512
MISS = 1e-6  # chance that bands miss a pair at the threshold
TILE = 256
FEW_PAIRS, TOGETHER = 64, 1 << 20  # up to so many pairs of a tile, or beyond so many shingles, pairs are compared one by one
HUBS = 4  # classes of a bucket that all others meet first
TILE_SHINGLES = 1 << 22
_rng = np.random.default_rng(9)
_A = _rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)
_STEP = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
WORD_BYTES = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): as many rows as keep the chance of a miss at the threshold under MISS."""
    return next((SAMPLES // r, r) for r in range(12, 0, -1) if (1 - threshold**r) ** (SAMPLES // r) <= MISS or r == 1)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of the k-word shingles of each text."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw).lower(), np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    a, b = cp.runs(WORD_BYTES[data])
    words = cp.run_hashes(data, a, b) if len(a) else np.zeros(0, np.uint64)
    first = np.searchsorted(a, starts)
    last = np.searchsorted(a, starts + sizes)
    full = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        full += words[j : len(full) + j] * _STEP[j]
    full = cp.mix(full)
    out = []
    for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(full[lo : hi - k + 1]))
        elif hi > lo:
            # Marked with its length, so that it equals no full shingle.
            terms = np.append(words[lo:hi] * _STEP[: hi - lo], _STEP[-1 - (hi - lo)])
            out.append(cp.mix(terms.sum(keepdims=True, dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(fingerprints: np.ndarray) -> np.ndarray:
    x = (fingerprints >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, (x[at : at + 4096, None] * _A + _B).min(0))
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """Odd sketches of rows of MinHash samples: rows x (SKETCH_BITS / 64) words."""
    rows = len(samples)
    bit = cp.mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    at = (bit.astype(np.int64) + np.arange(rows)[:, None] * SKETCH_BITS).ravel()
    odd = (np.bincount(at, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8).reshape(rows, SKETCH_BITS)
    return np.packbits(odd, axis=1, bitorder="little").view("<i8")


def most_different(threshold: float) -> int:
    """Differing bits up to which a candidate is confirmed: those of a similarity five standard
    deviations below the threshold, and five of the sketch's own."""
    low = max(0.0, threshold - 5 * (threshold * (1 - threshold) / SAMPLES) ** 0.5)
    flips = 2 * SAMPLES * (1 - low)
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return int(mean + 5 * (mean * (1 - mean / SKETCH_BITS)) ** 0.5) + 1


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 |x & y| >= percent |x | y| on sorted distinct arrays."""
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each left and each right array, both sorted and distinct."""
    x, y = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(x, y)
    sides = []
    for flat, arrays in ((x, left), (y, right)):
        row, at = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays]), np.searchsorted(common, flat)
        here = at < len(common)
        here[here] = common[at[here]] == flat[here]
        sides.append((row[here], at[here], len(arrays)))
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, len(common), 2048):
        planes = []
        for row, at, n in sides:
            now = (at >= lo) & (at < lo + 2048)
            plane = np.zeros((n, 2048), np.float32)
            plane[row[now], at[now] - lo] = 1
            planes.append(plane)
        out += (planes[0] @ planes[1].T).astype(np.int64)
    return out


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        mark = np.arange(bands, dtype=np.uint64) * _STEP[-2]
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), k)
                n = len(sets)
                samples = np.stack([minhash(s) for s in sets])
                keys = np.broadcast_to(mark, (n, bands)).copy()
                for j in range(rows):
                    keys = cp.mix(keys + samples[:, j : bands * rows : rows].astype(np.uint64) * _STEP[j])
                digests = [np.array([s.sum(dtype=np.uint64), cp.mix(s).sum(dtype=np.uint64)]).view(np.int64) for s in sets]
                odd = sketches(samples)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("row"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64())),
                        pa.FixedSizeListArray.from_arrays(pa.array(odd.ravel()), SKETCH_BITS // 64).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "row", "n", "d1", "d2", "bands", "sketch"],
                )

    return run


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), k)
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["rep", "fp"])

    return run


def _tile_links(percent: int, different: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found = []
        if len(left) and len(right):
            x, y = (np.stack([np.asarray(s, np.int64) for s in side["sketch"]]).view(np.uint64) for side in (left, right))
            apart = np.zeros((len(x), len(y)), np.int32)
            for word in range(x.shape[1]):
                apart += np.bitwise_count(x[:, word, None] ^ y[:, word])
            nx, ny = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None]
            fits = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
            # Components by number; only pairs of two of them are open.
            numbers, codes = np.unique(pd.concat([left["comp"], right["comp"]]).to_numpy(), return_inverse=True)
            lc, rc, joined = codes[: len(left)], codes[len(left) :], np.arange(len(numbers))
            at, to = np.nonzero((apart <= different) & fits & (lc[:, None] != rc))
            order = np.argsort(apart[at, to], kind="stable")  # the likeliest pairs first
            at, to = at[order], to[order]
            lr, rr = left["rep"].tolist(), right["rep"].tolist()
            ls, rs = ([np.asarray(f, np.int64).view(np.uint64) for f in side["fp"]] for side in (left, right))
            confirm = len(at) <= FEW_PAIRS or nx.sum() + ny.sum() > TOGETHER
            if not confirm:
                both = shared(ls, rs)
                linked = (100 * both >= percent * (nx + ny - both))[at, to]
                at, to = at[linked], to[linked]
            while len(at):
                p, q = int(at[0]), int(to[0])
                if not confirm or similar(ls[p], rs[q], percent):
                    x, y = joined[lc[p]], joined[rc[q]]
                    joined[joined == max(x, y)] = min(x, y)
                    found.append((lr[p], rr[q]))
                # Once joined, a component's other pairs need no comparison.
                open_ = joined[lc[at]] != joined[rc[to]]
                open_[0] = False
                at, to = at[open_], to[open_]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def row_key():
    """One number for a row's id and text."""
    return F.xxhash64("doc_id", "text")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs (doc_id, text)."""
    return near_groups(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """near_components with each row's key (row) and its component's row to keep: chosen (doc_id,
    row), the one with the smallest id, null ids last; null without shingles."""
    bands, rows = banding(percent / 100)
    different = most_different(percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", row_key())
    schema = "doc_id long, row long, n long, d1 long, d2 long, bands array<bigint>, sketch array<bigint>"
    signed = docs.mapInArrow(_signatures(k, bands, rows), schema)
    sig = materialize(signed.withColumn("at", F.monotonically_increasing_id()), "signatures")
    same = ["d1", "d2", "n"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at")).alias("best")
    # A class is known by a number given once, when its table is written.
    classes = materialize(sig.where("n > 0").groupBy(*same).agg(best).withColumn("rep", F.monotonically_increasing_id()), "classes")
    lead = classes.select("rep", F.col("best.doc_id").alias("lead_id"), F.col("best.row").alias("lead_row"), F.col("best.at").alias("at"))
    cls = sig.join(lead.select("rep", "at"), "at").select("rep", "n", "bands", "sketch")
    keyed = cls.select("rep", "n", F.explode("bands").alias("key"))
    drawn = (F.min_by("rep", F.xxhash64("rep", F.lit(seed))) for seed in range(HUBS - 2))
    hubs = keyed.groupBy("key").agg(F.array_distinct(F.array(F.min("rep"), F.max("rep"), *drawn)).alias("hubs"), F.count("*").alias("c")).where("c > 1")
    members = materialize(keyed.join(hubs, "key").select("key", "hubs", "c", "rep", "n"), "members")

    # Full sets of the classes that share a bucket, and of no others.
    wanted = members.select("rep").distinct()
    facts = cls.join(wanted, "rep").select("rep", "n", "sketch")
    leads = lead.join(wanted, "rep").select("rep", "lead_id", "lead_row")
    # Rows equal to the one that leads its class come with it.
    texts = docs.join(leads, (F.col("row") == F.col("lead_row")) & F.col("doc_id").eqNullSafe(F.col("lead_id"))).select("rep", "text")
    sets = texts.mapInArrow(_set_rows(k), "rep long, fp array<bigint>").dropDuplicates(["rep"])
    facts = materialize(sets.join(facts, "rep"), "sets")

    # 1. Each member against its bucket's hubs.
    met = members.select("rep", F.explode("hubs").alias("hub")).where("rep <> hub")
    pairs = met.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    slim = facts.select("rep", "n", "sketch")
    pa_, pb_ = (slim.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for s in "ab")
    apart = sum((F.bit_count(F.col("sa")[w].bitwiseXOR(F.col("sb")[w])) for w in range(SKETCH_BITS // 64)), F.lit(0))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    likely = materialize(pairs.join(pa_, "a").join(pb_, "b").where(fits & (apart <= different)).select("a", "b"), "likely")
    fa, fb = (facts.select(F.col("rep").alias(s), F.col("fp").alias(f"f{s}")) for s in "ab")
    both = F.size(F.array_intersect("fa", "fb"))
    links = likely.join(fa, "a").join(fb, "b").where(100 * both >= percent * (F.size("fa") + F.size("fb") - both))
    links = materialize(links.select("a", "b"), "links")
    parts = connected_components(links)

    # 2. Buckets of three or more classes that still lie in more than one component.
    labelled = members.where("c > 2").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    spread = labelled.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"),
        F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"),
    ).where("lo <> hi")
    # Buckets of other bands with the same members are the same work.
    once = spread.groupBy("sum", "c").agg(F.min("key").alias("key")).select("key")
    labelled = opened = materialize(labelled.join(once, "key"), "open")
    # Only pairs across components are open. Classes outside a bucket's largest component (side 0)
    # meet all of its classes (side 1), in tiles; pairs within the largest one never do.
    # Tiles are cut by classes and by shingles, so that long documents don't make heavy ones.
    sizes = labelled.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("load"))
    bulk = F.struct("m", F.negate("comp"))

    def tiles(m, load):
        return F.ceil(F.greatest(m / TILE, load / TILE_SHINGLES)).cast("int")

    largest = sizes.groupBy("key").agg(
        F.max_by("comp", bulk).alias("main"), tiles(F.sum("m"), F.sum("load")).alias("all_tiles"),
        tiles(F.sum("m") - F.max("m"), F.sum("load") - F.max_by("load", bulk)).alias("own_tiles"),
    )
    # Written first, so that the join's sides are plain scans and a hot bucket's task can be split.
    largest = materialize(largest, "largest")
    open_ = labelled.join(largest, "key").join(facts.drop("n"), "rep")
    tile = F.xxhash64("rep", F.lit(5))

    def spread_over(side: int, rows: DataFrame, mine: str, theirs: str) -> DataFrame:
        rows = rows.withColumn("tile", F.pmod(tile, F.col(f"{mine}_tiles")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"{theirs}_tiles") - 1)))
        i, j = ("tile", "other") if side == 0 else ("other", "tile")
        return rows.select("key", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "rep", "n", "sketch", "fp", "comp")

    dealt = spread_over(0, open_.where("comp <> main"), "own", "all").union(spread_over(1, open_, "all", "own"))
    more = dealt.groupBy("key", "i", "j").applyInPandas(_tile_links(percent, different), "a long, b long")
    more = materialize(more, "links")
    if not more.isEmpty():
        stars = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
        parts = connected_components(stars.union(more))

    labelled = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*same, "best", F.coalesce("component", "rep").alias("component"))
    # Both written first, so that the join's sides are plain scans and a hot component's task can be split.
    labelled = materialize(labelled, "labelled")
    chosen = materialize(labelled.groupBy("component").agg(F.min("best").alias("chosen")), "chosen")
    found = materialize(labelled.join(chosen, "component").select(*same, "chosen"), "found")
    drop(members, facts, likely, links, opened, largest, more, labelled, chosen)
    component = F.when(F.col("n") > 0, F.col("chosen.doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    out = sig.select("doc_id", "row", *same).join(found, same, "left").select("doc_id", F.col("n").alias("n_shingles"), component, "row", "chosen")
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))
