"""Sharding (operator 5): a uniform shuffle into shards of exact size, by a communication matrix.

1. Rows fall into source partitions by a hash; one aggregate counts them.
2. A hypergeometric draw splits each partition's count over the shards, so that the row sums are
   the partitions' counts and the column sums the shards' sizes (at most one apart). This is the
   only part made on the driver: partitions x shards numbers.
3. Each partition permutes its rows (a window in random-key order) and sends the first M[p, 0] to
   shard 0, the next M[p, 1] to shard 1, and so on.
4. Each shard permutes what it got. Its random keys are cut into buckets that are ranked apart and
   offset by their counts, so no task holds a whole shard. The rank is the slot.

Only DataFrame and SQL functions touch rows. Null ids and texts are hashed like values; rows that
are equal in all columns are interchangeable; an empty table gives no rows. A column of the input
named like a result column is replaced; no other name matters. Very long texts are rows like others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemforge.llm.common import materialize

ROWS_PER_PARTITION = 50_000
LEAST_PARTITIONS = 256


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """partitions x shards counts, drawn as by a uniform shuffle with equal shard sizes."""
    total = sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for k, n in enumerate(counts):
        # Conditional draws shard by shard: numpy's own hypergeometric is bounded at 1e9 a side.
        need, rest = n, int(left.sum())
        for s in range(shards):
            rest -= int(left[s])
            out[k, s] = _draw(rng, int(left[s]), rest, need)
            need -= int(out[k, s])
        left -= out[k]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """One hypergeometric number: how many of `take` drawn rows are among the `good` ones."""
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, take))
    return by_inversion(rng, good, bad, take)


def by_inversion(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """The same law at any size. Chances relative to the mode's follow from the ratios of
    neighbours; beyond 50 deviations they are far below what a double can show."""
    low, high, n = max(0, take - bad), min(good, take), good + bad
    mode = min(max((good + 1) * (take + 1) // (n + 2), low), high)
    width = int(50 * (take * (good / n) * (bad / n) + 1) ** 0.5) + 50
    up = np.arange(mode, min(high, mode + width), dtype=np.float64)
    down = np.arange(mode, max(low, mode - width), -1, dtype=np.float64)
    more = np.cumprod((good - up) * (take - up) / ((up + 1) * (bad - take + up + 1)))
    less = np.cumprod(down * (bad - take + down) / ((good - down + 1) * (take - down + 1)))
    upto = np.cumsum(np.concatenate([less[::-1], [1.0], more]))
    return mode - len(less) + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def shard(df: DataFrame, shards: int = 16, seed: int = 20, partitions: int | None = None) -> DataFrame:
    """df with shard (0 to shards-1, counts at most one apart) and slot (gapless from 0 in each)."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    # The row travels as one struct, so that no name of its columns can meet one of ours.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *(c.alias(f"c{k}") for k, c in enumerate(_hashable(df, names))))
    keys = [c for c in rows.columns if c != "row"]
    # Two independent random keys of the row's content. Equal rows tie, which is harmless.
    rows = rows.withColumn("a", F.xxhash64(F.lit(seed), *keys)).withColumn("b", F.xxhash64(F.lit(~seed), F.col("a"), F.hash(*keys)))
    if partitions is None:
        partitions = max(LEAST_PARTITIONS, -(-rows.count() // ROWS_PER_PARTITION))
    rows = rows.withColumn("p", F.pmod(F.xxhash64(F.lit(seed + 1), "a", "b"), F.lit(partitions)).cast("int"))
    counts = dict(rows.groupBy("p").count().collect())  # one number a partition
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], shards, seed)
    upto = np.cumsum(matrix, axis=1)
    spark = df.sparkSession
    cuts = spark.createDataFrame([(p, u.tolist()) for p, u in zip(order, upto, strict=True)], "p int, upto array<bigint>")
    local = rows.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("a", "b", *keys)))
    # The first shard whose running count reaches the row's local rank.
    sent = local.join(cuts, "p").withColumn("shard", F.size(F.filter("upto", lambda u: u < F.col("i"))))
    sent = sent.withColumn("g", F.pmod(F.shiftrightunsigned("b", 20), F.lit(_buckets(partitions, shards))).cast("int"))
    # Rows that share b are equal or tie by the local rank, which is written here once.
    sent = materialize(sent.select("row", "b", "p", "i", "shard", "g"), "shard")
    sizes = sent.groupBy("shard", "g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("shard", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = sent.withColumn("j", F.row_number().over(Window.partitionBy("shard", "g").orderBy("b", "p", "i")))
    return ranked.join(base, ["shard", "g"]).select(*(F.col("row")[c].alias(c) for c in names), "shard", (F.col("base") + F.col("j") - 1).cast("long").alias("slot"))


def _buckets(partitions: int, shards: int) -> int:
    return max(16, -(-partitions // shards))


def _hashable(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns, those that hold maps or variants as JSON: Spark neither hashes nor orders them."""
    odd = {f.name for f in df.schema.fields if any(x in f.dataType.simpleString() for x in ("map<", "variant"))}
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if c in odd else F.col(f"`{c}`") for c in names]
