"""Stored tables: where lineage ends and what later steps read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs that a broadcast may hold (about 16 MB); larger sides are shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary one; a cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    at = at or spark.sparkContext.getCheckpointDir() or ""
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="hopweave-shared-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hopweave-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a side whose counted rows are few; else leave it to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder of stored tables that no later plan reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def counted_write(df: DataFrame, path: str, **more: Column) -> dict[str, int]:
    """Write a table and count it in the same job: n, and whatever else is asked for (aggregates over its rows)."""
    seen = Observation()
    aggregates = {"n": F.count(F.lit(1)), **more}
    df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]).write.parquet(path)
    found = seen.get
    if "n" not in found:  # an empty table whose plan was cut short
        return {k: 0 for k in aggregates}
    return {k: found[k] or 0 for k in aggregates}


def clustered(df: DataFrame, key: str, path: str) -> DataFrame:
    """Write a table in buckets of its key, each sorted by it, and read it back: joins on the key don't move it, and literal keys prune buckets and row groups."""
    spark, name = df.sparkSession, f"hopweave_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)
