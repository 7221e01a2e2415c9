"""Views over the test tables that give every operator its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

E_CHAIN = """SELECT l_partkey AS src, dst, l_quantity AS q FROM (
  SELECT l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst
  FROM {lineitem}) t WHERE dst IS NOT NULL"""

VIEWS = {
    "e_dense_multi": "SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (" + E_CHAIN + ") c",
    "e_dense": "SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (" + E_CHAIN + ") c",
    "e_sparse": "SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (" + E_CHAIN + ") c WHERE q <= 5",
    "n_part": "SELECT CAST(p_partkey AS BIGINT) AS page_id, concat('Part ', CAST(p_partkey AS VARCHAR(20))) AS page_title, p_type = 'ECONOMY' AS page_is_redirect FROM {part}",
    "d_page": """SELECT CAST(p_partkey AS BIGINT) AS page_id, CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END AS page_namespace,
       concat('Part_', CAST(CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR(20))) AS page_title,
       p_type = 'ECONOMY' AS page_is_redirect FROM {part}""",
    "d_linktarget": """SELECT CAST(1000000 + p_partkey AS BIGINT) AS lt_id, CASE WHEN p_partkey % 11 = 0 THEN 14 ELSE 0 END AS lt_namespace,
       concat(CASE WHEN p_partkey % 13 = 0 THEN 'Missing_' ELSE 'Part_' END, CAST(p_partkey AS VARCHAR(20))) AS lt_title FROM {part}""",
    "d_pagelinks": "SELECT CAST(src AS BIGINT) AS pl_from, CASE WHEN src % 17 = 0 THEN 1 ELSE 0 END AS pl_from_namespace, CAST(1000000 + dst AS BIGINT) AS pl_target_id FROM (" + E_CHAIN + ") c",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over a folder of tables."""
    return spark.sql(VIEWS[name].format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`", part=f"parquet.`{sf_dir}/part.parquet`"))


_O_CHAIN = """WITH k AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n FROM lineitem)
  SELECT CAST(a.l_partkey AS BIGINT) AS src, CAST(b.l_partkey AS BIGINT) AS dst, a.l_quantity AS q FROM k a JOIN k b ON b.l_orderkey = a.l_orderkey AND b.n = a.n + 1"""
#: The same views in DuckDB's own words, from another formulation where there is one, so that a slip in a view shows.
ORACLE_VIEWS = {
    "e_dense_multi": f"SELECT src, dst FROM ({_O_CHAIN}) c",
    "e_dense": f"SELECT src, dst FROM ({_O_CHAIN}) c GROUP BY src, dst",
    "e_sparse": f"SELECT src, dst FROM ({_O_CHAIN}) c WHERE NOT q > 5 GROUP BY src, dst",
    "n_part": "SELECT p_partkey::BIGINT AS page_id, 'Part ' || p_partkey AS page_title, p_type IN ('ECONOMY') AS page_is_redirect FROM part",
    "d_page": "SELECT p_partkey::BIGINT AS page_id, (p_size % 10 = 0)::INTEGER AS page_namespace, 'Part_' || (p_partkey - (p_partkey % 50 = 49)::INTEGER) AS page_title, p_type IN ('ECONOMY') AS page_is_redirect FROM part",
    "d_linktarget": "SELECT p_partkey::BIGINT + 1000000 AS lt_id, 14 * (p_partkey % 11 = 0)::INTEGER AS lt_namespace, if(p_partkey % 13 = 0, 'Missing_', 'Part_') || p_partkey AS lt_title FROM part",
    "d_pagelinks": f"SELECT src AS pl_from, (src % 17 = 0)::INTEGER AS pl_from_namespace, dst + 1000000 AS pl_target_id FROM ({_O_CHAIN}) c",
}


def oracle(name: str) -> str:
    """The view for DuckDB, whose tables are registered by name."""
    return ORACLE_VIEWS[name]
