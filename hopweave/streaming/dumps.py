"""Dump files as they arrive.

The engine's queries are batch queries: a graph is built from whole dumps. What
streams is ingestion: dump files that land in a folder are parsed by the same
expressions as in batch, and appended to the Parquet tables that batch reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.dumps import SCANS


def stream(spark: SparkSession, folder: str, kind: str, title_mode: str = "strict") -> DataFrame:
    """A streaming table of the rows of `*-<kind>.sql.gz` files that land in a folder."""
    lines = spark.readStream.option("pathGlobFilter", f"*-{kind}.sql*").text(folder)
    return SCANS[kind](lines.where(F.col("value").startswith("INSERT INTO")), title_mode)


def append(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived to a Parquet table, each file once, and stop."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
