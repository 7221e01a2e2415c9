"""A link graph as two tables, and what can be asked of it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..sources.tables import clustered, deleted, new_path, stored
from . import paths as walk
from .resolve import resolve_linktargets, resolve_links, title_index


class BlankTitle(ValueError):
    """A title of white space only."""


class UnknownTitle(ValueError):
    """A title that is no page's."""


@dataclass
class LinkGraph:
    """nodes (page_id, page_title, page_is_redirect) and edges (src, dst). Redirects are ordinary nodes."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def resolved(cls, pages: DataFrame, linktargets: DataFrame, pagelinks: DataFrame, multigraph: bool = False) -> LinkGraph:
        """Resolve dump tables into a graph; repeated links count once unless multigraph. Nothing is stored yet."""
        index = title_index(pages)
        edges = resolve_links(pagelinks, pages, resolve_linktargets(linktargets, index))
        return cls(pages.select("page_id", "page_title", "page_is_redirect"), edges if multigraph else edges.distinct())

    @classmethod
    def build(cls, pages: DataFrame, linktargets: DataFrame, pagelinks: DataFrame, multigraph: bool = False) -> LinkGraph:
        """The same, with its edges stored in buckets of their source."""
        return cls.resolved(pages, linktargets, pagelinks, multigraph).stored()

    def stored(self) -> LinkGraph:
        """The same graph with its edges in the shared folder, in buckets of their source and sorted by it: searches prune by literal sources and never move an edge."""
        return LinkGraph(self.nodes, clustered(self.edges, "src", new_path(self.spark, "edges")))

    def save(self, path: str) -> LinkGraph:
        """Keep the graph in a folder of its own; `open` reads it again. An existing folder is replaced."""
        path = path.rstrip("/")
        deleted(self.spark, path)
        self.nodes.write.parquet(f"{path}/nodes")
        edges = clustered(self.edges, "src", f"{path}/edges")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/form")
        return LinkGraph(self.spark.read.schema(self.nodes.schema).parquet(f"{path}/nodes"), edges)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LinkGraph:
        """A graph that `save` has kept, its edges in their buckets."""
        path = path.rstrip("/")
        buckets, name = spark.read.parquet(f"{path}/form").first()["buckets"], f"hopweave_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} (src BIGINT, dst BIGINT) USING parquet CLUSTERED BY (src) SORTED BY (src) INTO {buckets} BUCKETS LOCATION '{path}/edges'")
        return cls(spark.read.parquet(f"{path}/nodes"), spark.table(name))

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def counts(self) -> DataFrame:
        """One row: n_nodes, n_links."""
        return self.nodes.agg(F.count("*").alias("n_nodes")).crossJoin(self.edges.agg(F.count("*").alias("n_links")))  # two single rows

    def out_degree(self) -> DataFrame:
        return self.edges.groupBy("src").agg(F.count("*").alias("out_degree"))

    def degree_of(self, node: int) -> DataFrame:
        """One row: the node's links out (0 for an unknown one)."""
        return self.edges.where(F.col("src") == node).agg(F.count("*").alias("out_degree"))

    def adjacency(self) -> DataFrame:
        """page_id -> dsts, sorted; empty for a node without links."""
        lists = self.edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("dsts"))
        return self.nodes.select("page_id").join(lists, F.col("page_id") == F.col("src"), "left").select("page_id", F.coalesce("dsts", F.array().cast("array<bigint>")).alias("dsts"))

    def node_index(self) -> DataFrame:
        """Dense index from 0 in id order, for those who need one: ids are ranged out, each range counted, and its rows numbered from there."""
        ids = stored(self.nodes.select("page_id").repartitionByRange("page_id").withColumn("range", F.spark_partition_id()), "ids")
        sizes = {r["range"]: r["count"] for r in ids.groupBy("range").count().collect()}  # one row for each partition
        base, rows = 0, []
        for k in sorted(sizes):
            rows.append((k, base))
            base += sizes[k]
        from pyspark.sql import Window

        starts = self.spark.createDataFrame(rows, "range int, base long")
        own = F.row_number().over(Window.partitionBy("range").orderBy("page_id"))
        return ids.join(F.broadcast(starts), "range").select("page_id", (own - 1 + F.col("base")).alias("node_index"))

    def title_lookup(self, title: str) -> DataFrame:
        """page_id, page_title of a trimmed title: the first page that has it, no rows if none does."""
        return title_index(self.nodes.where(F.col("page_title") == trimmed(F.lit(title)))).select("page_id", "page_title")

    def resolve(self, title: str) -> int:
        if not title.strip(" \t\n\r\f\v"):
            raise BlankTitle("a title is needed")
        row = self.title_lookup(title).first()
        if row is None:
            raise UnknownTitle(f"no page is called {title.strip()!r}")
        return row["page_id"]

    def has(self, node: int) -> bool:
        return bool(self.nodes.where(F.col("page_id") == node).limit(1).count())

    def bfs(self, start: int, end: int | None = None) -> walk.Layers:
        return walk.bfs(self.spark, self.edges, start, end, self.has(start))

    def all_shortest_paths(self, start: int, end: int, limit: int | None = None) -> DataFrame:
        """Unknown nodes give no rows."""
        return walk.all_shortest_paths(self.spark, self.edges, start, end, limit, self.has(start) and self.has(end))

    def count_shortest_paths(self, start: int, end: int) -> DataFrame:
        return walk.count_shortest_paths(self.spark, self.edges, start, end, self.has(start) and self.has(end))

    def search(self, start_title: str, end_title: str, limit: int | None = None) -> DataFrame:
        """All shortest paths between two titles: path, titles, path_text. BlankTitle or UnknownTitle where a title is none."""
        start, end = self.resolve(start_title), self.resolve(end_title)
        return walk.path_titles(self.all_shortest_paths(start, end, limit), self.nodes)
