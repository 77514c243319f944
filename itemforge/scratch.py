"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder
    of our own is made, but only for a local session: its disk is the executors' disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = getattr(spark, "_itemforge_shared", None)
        if not found:
            own = tempfile.mkdtemp(prefix="itemforge-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            found = spark._itemforge_shared = "file://" + own
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again. The files are
    shared and committed, so later stages survive the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._itemforge_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._itemforge_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
