"""Helpers shared by the training-data operators: table reading, slices of batches, graph components."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.scratch import drop, materialize, scratch_path, shared_dir

__all__ = ["connected_components", "drop", "held", "materialize", "release", "scratch_path", "shared_dir", "table", "text_or_empty", "text_slices"]


_held: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """The one large object, such as an encoder with its cache, that a Python worker keeps between
    tasks. Workers outlive a stage, so asking for another one drops the one before."""
    if key not in _held:
        release()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Drop what held keeps; called by operators that need no such object."""
    _held.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def text_slices(batch: pa.RecordBatch, text: str | int, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most rows rows and, longer single texts apart, size bytes of text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = upto[at - 1] if at else 0
        to = min(max(int(np.searchsorted(upto, done + size, side="right")), at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end (a) has one edge and is no smaller end (b): components are known then."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    ups = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
    return not ups.agg(F.count_if(F.expr("up > 1 or up = 1 and low = 0"))).first()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: (a long, b long), in either direction, repeats allowed. Returns (node, component), one
    row per node. Alternating large-star and small-star steps: each round is two shuffles of at
    most as many rows as there are edges, and hub nodes are pre-reduced by a partial min. Each
    round ends in a written table, so lineage stays short; all but the last are dropped. Empty input
    gives no rows.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    for _ in range(max_rounds):
        if _stars(edges):
            break
        # Large star: every larger neighbour of a node moves to the node's smallest neighbour.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's smaller neighbours, and the node, move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        nxt = (
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        nxt = materialize(nxt, "cc")
        drop(edges)
        edges = nxt
    else:
        raise RuntimeError("components did not converge")
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
