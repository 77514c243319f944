"""Embedding near-dedup (operator 6): an exact metric range join of unit vectors.

cos(x, y) >= c is |x - y| <= r with r = sqrt(2 - 2c) on unit vectors. Within a label, pivots (a
hash-chosen, bounded number) split the vectors into cells of the nearest pivot. A vector x also goes
to every other cell that could hold a partner: y nearer to p_j than to p_i, within r of x, forces
|x - p_j| - |x - p_i| <= 2r, and, in the plane of the two pivots,
(|x - p_j|^2 - |x - p_i|^2) / (2 |p_i - p_j|) <= r; both follow from the triangle inequality. Cells
join on their own: the rows at home in a cell meet all rows sent to it, and a pair is kept in the
home cell of its smaller member. A cell above TILE rows is cut into tiles whose pairs join apart, so
no task holds a large cell.

A tile pair returns, for each vector, the number of its links, and only as many links as connect
what it found connected; all pairs are never emitted.

Vectors or labels that are null, zero vectors and vectors with null or non-finite components link
with nothing: 0 links, their own component. Equal vectors of a label are one class, joined once with
its number of rows. Rows are told apart by vec_id, which should be unique: rows that share one get
the sum of their links. Null ids get a null component and kept = false. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import connected_components, materialize

MAX_PIVOTS = 64
ROWS_PER_PIVOT = 1_000
TILE = 1_024
LINKS = "a long, b long, kind int, n long"


def _unit(x: list) -> np.ndarray:
    v = np.stack([np.asarray(e, np.float64) for e in x]) if len(x) else np.zeros((0, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spanning(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of links (a, b) enough to connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


def draw_pivots(vectors: DataFrame) -> DataFrame:
    """(label, parts, pivots) of the labels large enough for two pivots or more; parts of about TILE
    rows. The pivots are of the dimension of the first one drawn."""
    sizes = vectors.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * ROWS_PER_PIVOT)
    wanted = F.least(F.lit(MAX_PIVOTS), F.floor(F.col("n") / ROWS_PER_PIVOT).cast("int"))
    # At most one label in 2 * ROWS_PER_PIVOT rows. Of each, about twice the pivots are drawn.
    large = materialize(sizes.withColumn("wanted", wanted), "large_labels")
    share = F.least(F.lit(1.0), 2 * F.col("wanted") / F.col("n")) * (1 << 30)
    drawn = vectors.select("label", "row", "embedding").join(large, "label").where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < share)
    found = drawn.groupBy("label", "n", "wanted").agg(F.array_sort(F.collect_list(F.struct("row", "embedding"))).alias("drawn"))
    like = F.filter("drawn", lambda x: F.size(x["embedding"]) == F.size(F.col("drawn")[0]["embedding"]))
    return found.select("label", F.ceil(F.col("n") / TILE).cast("int").alias("parts"), F.transform(F.slice(like, 1, F.col("wanted")), lambda x: x["embedding"]).alias("pivots"))


def near_links(vectors: DataFrame, cosine: float) -> DataFrame:
    """Of usable vectors (row, label, w: rows that have it, embedding): kind 0, the links of row a
    (n, counted in rows); kind 1, a link a-b."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    pivots = materialize(draw_pivots(vectors), "pivots")

    def assign(key, pdf, drawn):
        p_all = _unit(list(drawn["pivots"].iloc[0])) if len(drawn) else None
        out = []
        for d, g in pdf.groupby(pdf["embedding"].map(len)):
            x = _unit(list(g["embedding"]))
            p = p_all if p_all is not None and p_all.shape[1] == d else np.zeros((1, d))  # another dimension: one cell
            dist = np.sqrt(np.maximum(0, 1 + (p * p).sum(1) - 2 * x @ p.T))
            home = dist.argmin(1)
            own = dist[np.arange(len(x)), home][:, None]
            apart = np.sqrt(np.maximum(0, ((p[:, None] - p[None]) ** 2).sum(2)))[home]
            reach = (dist - own <= 2 * radius) & (dist**2 - own**2 <= 2 * radius * apart + 1e-9)
            reach[np.arange(len(x)), home] = True
            at, cell = np.nonzero(reach)
            out.append(pd.DataFrame({"label": g["label"].to_numpy()[at], "dim": d, "cell": cell, "home": home[at], "row": g["row"].to_numpy()[at], "w": g["w"].to_numpy()[at], "embedding": [g["embedding"].iloc[i] for i in at]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["label", "dim", "cell", "home", "row", "w", "embedding"])

    kind = vectors.schema["label"].dataType.simpleString()
    known = vectors.select("row", "label", "w", "embedding").join(pivots.select("label", "parts"), "label", "left")
    # A label without pivots is one cell.
    one = known.where("parts is null").select(
        "label", F.size("embedding").alias("dim"), F.lit(0).alias("cell"), F.lit(0).alias("home"), "row", "w", F.col("embedding").cast("array<double>").alias("embedding")
    )
    # Parts of a label meet its pivots, so that neither goes through the driver or one task.
    split = known.where("parts is not null").withColumn("part", F.pmod(F.xxhash64("row", F.lit(11)), F.col("parts")).cast("int")).drop("parts")
    sent = pivots.select("label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivots")
    many = split.groupBy("label", "part").cogroup(sent.groupBy("label", "part")).applyInPandas(
        assign, f"label {kind}, dim int, cell int, home int, row long, w long, embedding array<double>"
    )
    placed = materialize(one.union(many), "cells")
    keys = ["label", "dim", "cell"]
    own = F.col("home") == F.col("cell")
    tiles = placed.groupBy(*keys).agg(
        F.ceil(F.count("*") / TILE).cast("int").alias("all_tiles"), F.ceil(F.count_if(own) / TILE).cast("int").alias("own_tiles")
    )
    placed = placed.join(tiles, keys)

    def spread(side: int, rows: DataFrame, mine: str, theirs: str) -> DataFrame:
        tile = F.pmod(F.xxhash64("row", F.lit(7)), F.col(f"{mine}_tiles")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(f"{theirs}_tiles") - 1))
        rows = rows.where(F.col("own_tiles") > 0).withColumn("tile", tile).withColumn("other", other).withColumn("side", F.lit(side))
        return rows.select(*keys, (F.col("tile") if side == 0 else F.col("other")).alias("i"), (F.col("other") if side == 0 else F.col("tile")).alias("j"), "side", "row", "w", "embedding")

    # Home rows of the cell (side 0, tile i) meet all of its rows (side 1, tile j), each pair of
    # tiles in a task of its own: never more comparisons than without cells.
    dealt = spread(0, placed.where(own), "own", "all").union(spread(1, placed, "all", "own"))

    def join(key, pdf):
        left, right = (pdf[pdf["side"] == k].sort_values("row") for k in (0, 1))
        if left.empty or right.empty:
            return pd.DataFrame(columns=["a", "b", "kind", "n"]).astype("int64")
        rx, ry = left["row"].to_numpy(), right["row"].to_numpy()
        near = _unit(list(left["embedding"])) @ _unit(list(right["embedding"])).T >= cosine
        # A pair is found in the home cell of its smaller member, and there only.
        at, to = np.nonzero(near & (rx[:, None] < ry))
        a, b = rx[at], ry[to]
        # A link to a class of equal vectors counts as many times as the class has rows.
        weight = np.concatenate([right["w"].to_numpy()[to], left["w"].to_numpy()[at]])
        rows, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        n = np.bincount(where, weight, len(rows)).astype(np.int64)
        keep = spanning(a, b)
        return pd.DataFrame({"a": np.concatenate([rows, a[keep]]), "b": np.concatenate([rows, b[keep]]), "kind": np.repeat([0, 1], [len(rows), len(keep)]), "n": np.concatenate([n, np.ones(len(keep), np.int64)])})

    return dealt.groupBy(*keys, "i", "j").applyInPandas(join, LINKS)


def near_components(df: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of df (vec_id, embedding, label)."""
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(good & finite & F.exists("embedding", lambda v: v != 0))
    # Equal vectors are one class: counted before the shuffle, joined once, never paired.
    classes = materialize(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("row"), F.count("*").alias("w")), "classes")
    member = usable.join(classes.select("label", "embedding", "row", "w"), ["label", "embedding"]).select("vec_id", "row", "w").distinct()
    found = materialize(near_links(classes, cosine), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "row")
    known = member.join(counts, "row", "left").join(parts, "row", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.min(F.coalesce("component", "row")).alias("component")
    )
    out = rows.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
