"""What the operators need from the session: shipped code, shared tables, size checks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
#: Rows of two longs that a broadcast may hold (about 16 MB); larger sides are shuffled.
BROADCAST_ROWS = 500_000


def ship(spark: SparkSession) -> None:
    """Give the executors this package once an application, wherever the driver found it, and hold Arrow batches to BATCH_ROWS."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="hopweave-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "hopweave_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


#: Rows of an Arrow batch between the JVM and a worker; kernels slice a batch by bytes, this bounds what lies in buffers on either side.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy(run):
    """The same function over batches, which gives memory back to the system when a task ends: workers outlive tasks."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return whole


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package at hand, in small batches, and memory given back at each task's end."""
    ship(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def relieved(spark: SparkSession) -> None:
    """Have the executors' JVMs collect and give back the heap that earlier work grew, which else stays for good: on every core a task that calls System.gc, before work that needs the room for its Python workers."""
    n = spark.sparkContext.defaultParallelism
    with contextlib.suppress(AnalysisException):  # reflection isn't allowed everywhere
        spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary one; a cluster must name it."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="hopweave-shared-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/hopweave-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing. The write counts its rows."""
    path, seen = new_path(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._hopweave_rows = seen.get.get("n")  # none for an empty table whose plan was cut short
    return out


def rows_of(df: DataFrame) -> int:
    """The rows of a table: known of a stored one, else counted."""
    n = getattr(df, "_hopweave_rows", None)
    return df.count() if n is None else n


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        for f in {x.rpartition("/")[0] for x in t.inputFiles()}:
            if "/hopweave-" in f:
                path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (stored) table is counted and found small; else leave it to a shuffle join."""
    return F.broadcast(df) if rows_of(df) <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
