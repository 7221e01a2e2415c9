"""Dump files written from the test tables, so that queries read them as the engine reads real ones.

Titles hold what a parser may stumble over (quotes, apostrophes, backslashes, a
tuple's end), namespaces may be negative, some ids are too large for their type,
and the columns that aren't read hold text that looks like a tuple.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dumps
from ..sources.tables import new_path
from .fixtures import view

LINE_ROWS = 50
#: Read alike by Spark and DuckDB: a title by the part's key (chr() spares the backslash, which the two quote differently), its plain form, and the numbers of a row.
TITLE = """CASE p_partkey % 7 WHEN 0 THEN concat('O', chr(39), 'Reilly_', p_partkey) WHEN 1 THEN concat('Say_', chr(34), 'Hi', chr(34), '_', p_partkey) WHEN 2 THEN concat('Back', chr(92), 'slash_', p_partkey)
  WHEN 3 THEN concat('Odd_(a),(b)_', p_partkey) WHEN 4 THEN concat('Zoë_', p_partkey) ELSE concat('Part_', p_partkey) END"""
NAMESPACE = "CASE p_size % 10 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END"
PAGE_ID = "CAST(p_partkey AS BIGINT) + CASE WHEN p_partkey % 97 = 5 THEN 4294967296 ELSE 0 END"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"""([\\'"])""", r"\\$1")


def _written(spark: SparkSession, rows: DataFrame, kind: str) -> str:
    """(n, tuple) -> a folder of gzip files with an INSERT line for every LINE_ROWS tuples, comments between them."""
    lines = rows.groupBy(F.floor(F.col("n") / LINE_ROWS).alias("line")).agg(F.array_sort(F.collect_list(F.struct("n", "tuple"))).alias("rows"))  # LINE_ROWS at most
    insert = F.concat(F.lit(f"INSERT INTO `{kind}` VALUES "), F.array_join(F.transform("rows", lambda r: r["tuple"]), ","), F.lit(";"))
    path = new_path(spark, f"dump-{kind}")
    lines.select(F.concat(F.lit("-- INSERT INTO nothing\n"), insert).alias("value")).write.option("compression", "gzip").text(path)
    return path


def _part(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(TITLE).alias("title"), F.expr(NAMESPACE).alias("ns"), F.expr(PAGE_ID).alias("id"), (F.col("p_type") == "ECONOMY").cast("int").alias("redirect"))


def page(spark: SparkSession, d: str, title_mode: str = "strict") -> DataFrame:
    rest = F.lit(r",0.5,'x (1,0,\'Ghost\',0)',NULL)")
    rows = _part(spark, d).select(F.col("p_partkey").alias("n"), F.concat(F.lit("("), F.col("id"), F.lit(","), F.col("ns"), F.lit(",'"), _escaped(F.col("title")), F.lit("',"), F.col("redirect"), rest).alias("tuple"))
    return dumps.scan(spark, _written(spark, rows, "page"), "page", title_mode)


def linktarget(spark: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("p_partkey") % 89 == 3, F.lit("18446744073709551615")).otherwise((F.col("p_partkey") + 1_000_000).cast("string"))
    rows = _part(spark, d).select(F.col("p_partkey").alias("n"), F.concat(F.lit("("), number, F.lit(","), F.col("ns"), F.lit(",'"), _escaped(F.col("title")), F.lit("')")).alias("tuple"))
    return dumps.scan(spark, _written(spark, rows, "linktarget"), "linktarget")


def pagelinks(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "e_dense").select(F.col("src").alias("n"), F.concat(F.lit("("), F.col("src") + F.when(F.col("src") % 101 == 7, F.lit(4294967296)).otherwise(F.lit(0)), F.lit(","), F.col("src") % 17, F.lit(","), F.col("dst") + 1_000_000, F.lit(")")).alias("tuple"))
    return dumps.scan(spark, _written(spark, rows, "pagelinks"), "pagelinks")


ORACLES = {
    "dump_page": f"SELECT {PAGE_ID} AS page_id, 0 AS page_namespace, replace({TITLE}, '_', ' ') AS page_title, p_type = 'ECONOMY' AS page_is_redirect FROM part WHERE p_size % 10 NOT IN (0, 1) AND p_partkey % 97 <> 5",
    "dump_page_compat": f"SELECT {PAGE_ID} AS page_id, 0 AS page_namespace, replace(replace({TITLE}, '_', ' '), chr(34), '') AS page_title, p_type = 'ECONOMY' AS page_is_redirect FROM part WHERE p_size % 10 NOT IN (0, 1) AND p_partkey % 97 <> 5 AND p_partkey % 7 NOT IN (0, 3)",
    "dump_linktarget": f"SELECT CAST(p_partkey + 1000000 AS BIGINT) AS lt_id, 0 AS lt_namespace, replace({TITLE}, '_', ' ') AS lt_title FROM part WHERE p_size % 10 NOT IN (0, 1) AND p_partkey % 89 <> 3",
}
