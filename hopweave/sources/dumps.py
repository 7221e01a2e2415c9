"""Gzip SQL dump files as DataFrames.

Only lines that begin with INSERT INTO hold rows. A gzip file is read by one
task; its lines (about 1 MB each) are dealt out before they are parsed, so the
parsing runs on all cores, and `materialized` keeps the result as Parquet, which
is what larger jobs read again. Parsing is Spark expressions only: a possessive
pattern finds the tuples (quotes respected), the namespace is tested before a
title is unescaped, and only the leading columns are captured.

title_mode "strict" reads titles right; "compat" reproduces a naive reader that
cuts tuples at `),(` even inside a title, ends a title at the first apostrophe,
and deletes escapes other than `\\'` and `\\\\`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UINT32_MAX, flag, spaced, unescaped, unsigned

_TITLE = r"'((?:[^'\\]|\\.)*+)'"
_REST = r"(?:,(?:'(?:[^'\\]|\\.)*+'|[^,()']*+))*+\)"
#: Strict tuples with all their columns, so that nothing inside a quoted column is taken for a tuple.
STRICT = {"page": rf"\((\d+),(-?\d+),{_TITLE},(\d+){_REST}", "linktarget": rf"\((\d+),(\d+),{_TITLE}{_REST}", "pagelinks": rf"\((\d+),(\d+),(\d+){_REST}"}
#: Compat tuples, matched from a fragment's begin.
COMPAT = {"page": r"^(\d+),(-?\d+),'([^']*)',(\d+)", "linktarget": r"^(\d+),(\d+),'([^']*)'", "pagelinks": r"^(\d+),(\d+),(\d+)"}
_WHOLE_ESCAPES = r"^(?:[^\\]|\\.)*+$"
_LONG_MAX = (1 << 63) - 1


def insert_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of a dump (plain or gzip) that insert rows; `partitions` deals them out for parsing (default: the session's parallelism)."""
    lines = spark.read.text(path).where(F.col("value").startswith("INSERT INTO"))
    return lines.repartition(partitions or spark.sparkContext.defaultParallelism)


def tuples(lines: DataFrame, kind: str, title_mode: str = "strict") -> DataFrame:
    """A row (t) for each tuple that parses, as an array of its captured columns."""
    if title_mode not in ("strict", "compat"):
        raise ValueError(f"title_mode is strict or compat, not {title_mode!r}")
    if title_mode == "strict":
        every = F.regexp_extract_all("value", F.lit(STRICT[kind]), F.lit(0))
        pattern = STRICT[kind]
    else:
        start = F.locate("(", F.col("value"))
        every = F.split(F.substr("value", start + 1, F.length("value") - 2 - start), r"\),\(")
        pattern = COMPAT[kind]
    rows = lines.select(F.explode(every).alias("tuple")).where(F.col("tuple").rlike(pattern))
    groups = 4 if kind == "page" else 3
    return rows.select(F.array(*[F.regexp_extract("tuple", pattern, g + 1) for g in range(groups)]).alias("t"))


def _title(raw: Column, title_mode: str) -> Column:
    return spaced(unescaped(raw, compat=title_mode == "compat"))


def _titled(rows: DataFrame, title_mode: str) -> DataFrame:
    """In compat mode a title whose last escape was cut off fails to parse."""
    return rows if title_mode == "strict" else rows.where(F.col("t")[2].rlike(_WHOLE_ESCAPES))


def page(lines: DataFrame, title_mode: str = "strict") -> DataFrame:
    """page_id, page_namespace, page_title, page_is_redirect of article pages."""
    rows = tuples(lines, "page", title_mode).where(F.col("t")[1].try_cast("int") == 0)
    out = _titled(rows, title_mode).select(unsigned(F.col("t")[0]).alias("page_id"), F.lit(0).alias("page_namespace"), _title(F.col("t")[2], title_mode).alias("page_title"), flag(F.col("t")[3]).alias("page_is_redirect"))
    return out.where("page_id is not null and page_is_redirect is not null")


def linktarget(lines: DataFrame, title_mode: str = "strict") -> DataFrame:
    """lt_id, lt_namespace, lt_title of targets that are article titles."""
    rows = tuples(lines, "linktarget", title_mode).where(unsigned(F.col("t")[1]) == 0)
    return _titled(rows, title_mode).select(unsigned(F.col("t")[0], _LONG_MAX).alias("lt_id"), F.lit(0).alias("lt_namespace"), _title(F.col("t")[2], title_mode).alias("lt_title")).where("lt_id is not null")


def pagelinks(lines: DataFrame, title_mode: str = "strict") -> DataFrame:
    """pl_from, pl_from_namespace, pl_target_id of links from article pages."""
    rows = tuples(lines, "pagelinks", title_mode).where(unsigned(F.col("t")[1]) == 0)
    return rows.select(unsigned(F.col("t")[0], UINT32_MAX).alias("pl_from"), F.lit(0).alias("pl_from_namespace"), unsigned(F.col("t")[2], _LONG_MAX).alias("pl_target_id")).where("pl_from is not null and pl_target_id is not null")


SCANS = {"page": page, "linktarget": linktarget, "pagelinks": pagelinks}


def scan(spark: SparkSession, path: str, kind: str, title_mode: str = "strict", partitions: int | None = None) -> DataFrame:
    """One dump file as a table."""
    return SCANS[kind](insert_lines(spark, path, partitions), title_mode)


def materialized(spark: SparkSession, source: str, target: str, kind: str, title_mode: str = "strict") -> DataFrame:
    """Parse a dump once into Parquet (splittable, prunable) and read that; an existing target is replaced."""
    scan(spark, source, kind, title_mode).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
