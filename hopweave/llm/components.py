"""Connected components over an edge table: alternating large-star and small-star steps.

Every step is two shuffles over the remaining edges, and ends in a stored table;
the number of steps grows with the logarithm of the longest chain. No edge or
label comes to the driver, only each step's row count and checksum.

A hub's edges never meet in one task: its least neighbour is aggregated on the
map side and comes back to the edges as a broadcast while the edges are counted
as few (a step has no more nodes than twice its edges); beyond that it is stored
first, and the join is of two stored tables, whose large partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, dropped, rows_of, stored


def _least(rows: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Of each `a` the least `b`, ready to be joined, and what was stored for it."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"))
    if few:
        return F.broadcast(least), []
    least = stored(least, "least")
    return least, [least]


def _large(e: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Each larger neighbour of a node goes to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, kept = _least(both, few)
    m = F.least("a", "m")
    return both.where("b > a").join(least, "a").where(F.col("b") != m).select(F.col("b").alias("a"), m.alias("b")).distinct(), kept


def _small(e: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Each smaller neighbour of a node, and the node, go to the least of them; a > b in every edge."""
    least, kept = _least(e, few)
    moved = e.join(least, "a").select("a", "b", "m")
    return moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), kept


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between ids -> (id, label): label is the smallest id reachable.

    Only ids with a link to another id appear; self-links, repeated and null
    links count as none. No links give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    while n := rows_of(now):
        mark = now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()["h"]
        if (n, mark) == seen:
            break
        seen, was, few = (n, mark), now, 2 * n <= BROADCAST_ROWS
        large, one = _large(now, few)
        if not few:
            large = stored(large, "large")
            one.append(large)
        now, two = _small(large, few)
        now = stored(now, "cc")
        dropped(was, *one, *two)
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label"))).distinct()
