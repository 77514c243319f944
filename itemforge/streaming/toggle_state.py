"""Toggles with their state in the state store: a value a key, written only where a batch changes it.

Each micro-batch counts a key's events and, if their number is odd, flips the key's stored value and
gives the change; keys that end as they began give nothing. Pairs of a key's events cancel out within
tasks, before and after rows are dealt by key, so that only keys that change reach the store, an
aggregate's. A restarted query goes on from its checkpoint, and any later session reads the states
themselves from the store, not from a table that the stream has to maintain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD_ROWS = 1 << 20  # events of a task in which pairs are looked for at once


def odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each key of which a task has an odd number."""

    def left(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        counts = table.group_by(table.column_names).aggregate([([], "count_all")])
        return counts.filter(pc.equal(pc.bit_wise_and(counts.column("count_all"), 1), 1)).select(table.column_names).to_batches(max_chunksize=1 << 14)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD_ROWS:
            held, n = left(held), 0
    if held:
        yield from left(held)


def changed(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, on) of the keys that a batch of the stream of events changes."""
    rows = events.select(*keys)
    flips = rows.mapInArrow(odd, rows.schema).repartition(*keys).mapInArrow(odd, rows.schema)
    return flips.groupBy(*keys).agg((F.bit_xor(F.lit(1)) == 1).alias("on"))


def run(events: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes under path, one folder a batch, until the source has no more; the query's own
    state is under checkpoint."""
    spark = events.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        stream = changed(events, keys).writeStream.outputMode("update").foreachBatch(write)
        query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        spark.conf.set(STORE, before)


def states(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """(keys) that are on, read from the state store of a query that isn't running."""
    store = spark.read.format("statestore").load(checkpoint)
    parity = store.schema["value"].dataType.names[0]  # the aggregate's buffer
    return store.where(F.col("value")[parity] == 1).select(*(F.col("key")[k].alias(k) for k in keys))
