"""Breadth-first search and shortest paths over an edge table.

A layer is one job: the edges that leave the frontier, without the nodes of the
layers before, are written as a partition of one table and counted by the same
job. So lineage doesn't grow with the depth, a lost executor costs one layer at
most, and the driver holds nothing but each layer's row count. A frontier of up
to LITERALS nodes is a literal list, which prunes the buckets and row groups of
edges that are stored by source; a larger one is broadcast while its counted
rows are few; beyond that it is shuffled to the edges' buckets, and the edges
stay where they are.

Shortest paths are walked back from the end: the step to a layer takes the edges
that enter the frontier and leave that layer, so nothing is built that doesn't
lead to the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined_titles
from ..sources.tables import counted_write, deleted, hinted, new_path, stored

#: Joins of a path chain before it is written out.
CHAIN = 8
#: Nodes that a frontier may have to be a literal list.
LITERALS = 500
WAYS = "decimal(38,0)"


@dataclass
class Layers:
    """dist: (node, dist); sizes: rows of each layer; found: the distance of the end node, if one was given and reached; path: where the layers are."""

    dist: DataFrame
    sizes: list[int]
    found: int | None
    path: str = ""

    def layer(self, k: int) -> DataFrame:
        return self.dist.sparkSession.read.schema("node long").parquet(f"{self.path}/dist={k}")

    def drop(self) -> None:
        """Delete the layers; dist can't be read any more."""
        if self.path:
            deleted(self.dist.sparkSession, self.path)


def _touching(edges: DataFrame, column: str, nodes: DataFrame, n: int) -> DataFrame:
    """The edges whose `column` is among n nodes."""
    if n <= LITERALS:
        return edges.where(F.col(column).isin([r["node"] for r in nodes.collect()]))  # LITERALS at most
    return edges.join(hinted(nodes, n), F.col(column) == F.col("node"), "left_semi")


def bfs(spark: SparkSession, edges: DataFrame, start: int, end: int | None = None, exists: bool = True) -> Layers:
    """Distances from `start` along (src, dst) edges, up to the layer that holds `end` or all that can be reached.

    `edges` should be a stored table, best in buckets of src. exists False (an
    unknown start) gives no rows. start = end is distance 0.
    """
    path = new_path(spark, "layers")
    none = spark.createDataFrame([], "node long, dist int")
    if not exists:
        return Layers(none, [], None)
    out = Layers(none, [], None, path)
    read = lambda: spark.read.schema("node long, dist int").parquet(path)
    spark.createDataFrame([(start,)], "node long").coalesce(1).write.parquet(f"{path}/dist=0")
    out.sizes.append(1)
    out.found = 0 if end == start else None
    while out.found is None:
        k = len(out.sizes)
        ahead = _touching(edges, "src", out.layer(k - 1), out.sizes[-1]).select(F.col("dst").alias("node")).distinct()
        new = ahead.join(hinted(read().select("node"), sum(out.sizes)), "node", "left_anti")
        counts = counted_write(new, f"{path}/dist={k}", hit=F.count_if(F.col("node") == F.lit(end)))
        if not counts["n"]:
            break
        out.sizes.append(counts["n"])
        if counts["hit"]:
            out.found = k
    out.dist = read()
    return out


def bfs_layers(layers: Layers, spark: SparkSession) -> DataFrame:
    """dist, layer_size, and the nodes explored up to that layer. A handful of rows, known from the search itself."""
    rows, total = [], 0
    for k, n in enumerate(layers.sizes):
        total += n
        rows.append((k, n, total))
    return spark.createDataFrame(rows, "dist int, layer_size long, explored long")


def shortest_path_dag(edges: DataFrame, layers: Layers) -> DataFrame:
    """Edges from one layer to the next: every shortest path from the start runs along these. src, dst, dist (of src)."""
    n = sum(layers.sizes)
    a = hinted(layers.dist.select(F.col("node").alias("src"), "dist"), n)
    b = hinted(layers.dist.select(F.col("node").alias("dst"), (F.col("dist") - 1).alias("dist")), n)
    return edges.join(a, "src").join(b, ["dst", "dist"]).select("src", "dst", "dist")


def _steps(spark: SparkSession, edges: DataFrame, layers: Layers, end: int, path: str) -> list[DataFrame]:
    """For each layer below the end's the edges (src, dst) that leave it and lead to the end, written and counted one by one from the end back."""
    steps: list[DataFrame] = []
    frontier, n = spark.createDataFrame([(end,)], "node long"), 1
    for k in range(layers.found - 1, -1, -1):
        step = _touching(_touching(edges, "dst", frontier, n), "src", layers.layer(k), layers.sizes[k])
        n = counted_write(step.select("src", "dst"), f"{path}/step={k}")["n"]
        steps.append(spark.read.schema("src long, dst long").parquet(f"{path}/step={k}"))
        frontier = steps[-1].select(F.col("src").alias("node")).distinct()
    return steps[::-1]


def all_shortest_paths(spark: SparkSession, edges: DataFrame, start: int, end: int, limit: int | None = None, exists: bool = True) -> DataFrame:
    """Every shortest path from start to end as `path array<long>`; repeated edges repeat paths. Unreachable: no rows.

    `limit` bounds the rows of the result, not the search. The result is stored;
    the search's own tables are deleted.
    """
    layers = bfs(spark, edges, start, end, exists)
    if layers.found is None:
        layers.drop()
        return spark.createDataFrame([], "path array<long>")
    at = new_path(spark, "steps")
    paths = spark.createDataFrame([([end],)], "path array<long>")
    steps = _steps(spark, edges, layers, end, at)
    for k in range(layers.found - 1, -1, -1):
        paths = paths.join(steps[k], F.element_at("path", 1) == F.col("dst")).select(F.concat(F.array("src"), "path").alias("path"))
        if k and k % CHAIN == 0:
            paths = stored(paths, "paths")
    paths = stored(paths if limit is None else paths.limit(limit), "paths")
    layers.drop()
    deleted(spark, at)
    return paths


def count_shortest_paths(spark: SparkSession, edges: DataFrame, start: int, end: int, exists: bool = True) -> DataFrame:
    """One row: distance (null if unreachable) and n_paths (decimal: counts outgrow a long), added up layer by layer without listing a path."""
    layers = bfs(spark, edges, start, end, exists)
    distance, n = layers.found, 0
    if distance is not None:
        at = new_path(spark, "steps")
        ways = spark.createDataFrame([(end,)], "node long").withColumn("n", F.lit(1).cast(WAYS))
        steps = _steps(spark, edges, layers, end, at)
        for k in range(distance - 1, -1, -1):
            ways = steps[k].join(ways, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.sum("n").cast(WAYS).alias("n"))
            if k and k % CHAIN == 0:
                ways = stored(ways, "ways")
        n = ways.first()["n"]
        deleted(spark, at)
    layers.drop()
    return spark.createDataFrame([(distance, str(n))], "distance int, n string").select("distance", F.col("n").cast(WAYS).alias("n_paths"))


def path_titles(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, titles in order, and their text joined by ` -> `; (path, titles, path_text). Repeated paths stay apart."""
    keyed = paths.withColumn("k", F.monotonically_increasing_id())
    keyed = stored(keyed, "paths")
    each = keyed.select("k", F.posexplode("path").alias("pos", "page_id")).join(nodes.select("page_id", "page_title"), "page_id")
    titles = each.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "page_title"))), lambda x: x["page_title"]).alias("titles"))
    return keyed.join(titles, "k").select("path", "titles", joined_titles(F.col("titles")).alias("path_text"))
