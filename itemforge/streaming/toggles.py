"""Toggle events as a stream: parity is kept in the state store, one counter a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from itemforge.scratch import drop, materialize


def toggle_stream(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    """Toggle events from a folder of Parquet files that arrive over time, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def toggled_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, on) of every key touched so far."""
    return events.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("on"))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed keys of each micro-batch, written under its number: repeats of a batch replace it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_from_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest state of each key from what to_table wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by("on", "batch").alias("on")).where("on").select(*keys)


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Put all batches but the last, which a restarted stream may write again, into one with the
    latest state of each key, so that readers don't read the whole past. Run between runs of the stream."""
    rows = spark.read.parquet(path)
    numbers = sorted(r["batch"] for r in rows.select("batch").distinct().collect())[:-1]  # one number a batch
    if len(numbers) < 2:
        return
    past = rows.where(F.col("batch") <= numbers[-1])
    whole = materialize(past.groupBy(*keys).agg(F.max_by("on", "batch").alias("on")), "compact")
    whole.write.mode("overwrite").parquet(f"{path}/batch={numbers[-1]}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in numbers[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}"), True)
    drop(whole)
