"""Every query of the link-graph engine by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined_titles, megabytes, percent, ratio, spaced, thousands
from ..operators import resolve
from ..operators.graph import LinkGraph
from ..operators.paths import bfs_layers, path_titles, shortest_path_dag
from ..sources import wikis
from . import inline, written
from .fixtures import oracle, view

#: The nodes and titles that graph queries start and end at.
START, END = 0, 77
FROM_TITLE, TO_TITLE = " Part 2\t", "Part 150"
DEPTH = 30


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "d_page").where("page_namespace = 0").withColumn("page_title", spaced(F.col("page_title")))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "d_linktarget").where("lt_namespace = 0").withColumn("lt_title", spaced(F.col("lt_title")))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "d_pagelinks").where("pl_from_namespace = 0")


def _graph(spark: SparkSession, d: str, edges: str) -> LinkGraph:
    return LinkGraph(view(spark, d, "n_part"), view(spark, d, edges)).stored()


def _as_text(paths: DataFrame) -> DataFrame:
    return paths.select(joined_titles(F.transform("path", lambda x: x.cast("string"))).alias("path_text"))


def _resolved(spark: SparkSession, d: str) -> LinkGraph:
    return LinkGraph.build(_pages(spark, d), _targets(spark, d), _links(spark, d))


def node_index(spark: SparkSession, d: str) -> DataFrame:
    return LinkGraph(_pages(spark, d), view(spark, d, "e_sparse")).node_index()


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d)
    return resolve.resolve_links(_links(spark, d), pages, resolve.resolve_linktargets(_targets(spark, d), resolve.title_index(pages)))


def bfs_distances(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, "e_sparse").bfs(START).dist


def shortest_distance(spark: SparkSession, d: str) -> DataFrame:
    found = _graph(spark, d, "e_sparse").bfs(START, END).found
    return spark.createDataFrame([] if found is None else [(found,)], "distance int")


def dag(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, "e_sparse")
    return shortest_path_dag(g.edges, g.bfs(START))


def path_unreachable(spark: SparkSession, d: str) -> DataFrame:
    """No path leads to a node that isn't there."""
    return _graph(spark, d, "e_sparse").all_shortest_paths(START, -1).agg(F.count("*").alias("n_paths"))


def path_unreachable_part(spark: SparkSession, d: str) -> DataFrame:
    """The first part that can't be reached, and the paths to it."""
    g = _graph(spark, d, "e_sparse")
    layers = g.bfs(START)
    target = g.nodes.join(layers.dist, F.col("page_id") == F.col("node"), "left_anti").agg(F.min("page_id")).first()[0]
    layers.drop()
    return g.all_shortest_paths(START, target).agg(F.count("*").alias("n_paths")).select(F.lit(target).cast("long").alias("target"), "n_paths")


def count_paths(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, "e_dense").count_shortest_paths(START, END).select("distance", F.col("n_paths").cast("long").alias("n_paths"))


def stats_rows(spark: SparkSession) -> DataFrame:
    return wikis.stats(spark.createDataFrame([(x,) for x in inline.STATS], "value string"))


def downloaded_rows(spark: SparkSession) -> DataFrame:
    return wikis.downloaded(spark.createDataFrame(inline.FILES, "file_name string, file_size long"))


def catalog_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as they are shown, in units of 100,000 bytes so that they differ, and the share of the page file."""
    rows = downloaded_rows(spark).withColumn("bytes", F.col("size_on_disk") * 100_000)
    return rows.select("language_code", "date", thousands(F.col("bytes")).alias("bytes"), megabytes(F.col("bytes")).alias("megabytes"), percent(ratio(F.col("page_size"), F.col("size_on_disk"))).alias("page_share"), ratio(F.col("page_size"), F.lit(0)).alias("of_nothing"))


def bfs_progress(spark: SparkSession, d: str) -> DataFrame:
    """Each layer's share of what was explored so far, and of the whole graph."""
    g = _graph(spark, d, "e_sparse")
    layers = bfs_layers(g.bfs(START), spark).crossJoin(g.nodes.agg(F.count("*").alias("n")))  # one row beside a handful
    return layers.select("dist", percent(ratio(F.col("layer_size"), F.col("explored"))).alias("layer_share"), F.round(ratio(F.col("explored"), F.col("n")), 6).alias("graph_share"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return LinkGraph(view(spark, d, "n_part"), view(spark, d, "e_dense")).adjacency().select("page_id", F.array_join(F.col("dsts").cast("array<string>"), ",").alias("dsts"))


def path_text(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, "e_dense")
    return path_titles(g.all_shortest_paths(START, END), g.nodes).select("path_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "all_shortest_paths": lambda s, d: _as_text(_graph(s, d, "e_dense").all_shortest_paths(START, END)),
    "all_shortest_paths_multi": lambda s, d: _as_text(_graph(s, d, "e_dense_multi").all_shortest_paths(START, END)),
    "all_shortest_paths_sparse": lambda s, d: _as_text(_graph(s, d, "e_sparse").all_shortest_paths(START, END)),
    "count_shortest_paths": count_paths,
    "path_text": path_text,
    "path_same_node": lambda s, d: _as_text(_graph(s, d, "e_sparse").all_shortest_paths(START, START)),
    "path_unreachable": path_unreachable,
    "path_unreachable_part": path_unreachable_part,
    "search_by_title": lambda s, d: _resolved(s, d).search(FROM_TITLE, TO_TITLE).select("path_text"),
    "bfs_distances": bfs_distances,
    "reachable_nodes": lambda s, d: bfs_distances(s, d).select("node"),
    "bfs_layers": lambda s, d: bfs_layers(_graph(s, d, "e_sparse").bfs(START), s),
    "shortest_distance": shortest_distance,
    "shortest_path_dag": dag,
    "page_scan": _pages,
    "linktarget_scan": _targets,
    "pagelinks_scan": _links,
    "title_index": lambda s, d: resolve.title_index(_pages(s, d)),
    "node_index": node_index,
    "resolve_linktargets": lambda s, d: resolve.resolve_linktargets(_targets(s, d), resolve.title_index(_pages(s, d))),
    "resolve_links": resolve_links,
    "red_links": lambda s, d: resolve.red_links(_targets(s, d), resolve.title_index(_pages(s, d))),
    "link_stats": lambda s, d: resolve.link_stats(_pages(s, d), _targets(s, d), _links(s, d)),
    "graph_edges": lambda s, d: resolve_links(s, d).distinct(),
    "graph_counts": lambda s, d: LinkGraph(_pages(s, d), resolve_links(s, d).distinct()).counts(),
    "out_degree": lambda s, d: LinkGraph(view(s, d, "n_part"), view(s, d, "e_dense")).out_degree(),
    "start_out_degree": lambda s, d: LinkGraph(view(s, d, "n_part"), view(s, d, "e_dense")).degree_of(START),
    "adjacency": adjacency,
    "title_lookup": lambda s, d: LinkGraph(_pages(s, d), view(s, d, "e_sparse")).title_lookup(FROM_TITLE),
    "catalog_stats": lambda s, d: stats_rows(s),
    "catalog_downloaded": lambda s, d: downloaded_rows(s),
    "catalog_list": lambda s, d: wikis.catalog(downloaded_rows(s), stats_rows(s)),
    "catalog_sizes": catalog_sizes,
    "bfs_progress": bfs_progress,
    "dump_page": written.page,
    "dump_page_compat": lambda s, d: written.page(s, d, "compat"),
    "dump_linktarget": written.linktarget,
    "dump_pagelinks": written.pagelinks,
    "dump_urls": lambda s, d: wikis.dump_urls(s.createDataFrame(inline.FEEDS, "wiki_prefix string, rss string")),
}


def _with(*views: str, more: str = "", recursive: bool = False) -> str:
    parts = [f"{v} AS ({oracle(v)})" for v in views]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*parts, *([more] if more else [])]) + "\n"


_ARTICLES = """page AS (SELECT page_id, page_namespace, replace(page_title, '_', ' ') AS page_title, page_is_redirect FROM d_page WHERE page_namespace = 0),
lt AS (SELECT lt_id, lt_namespace, replace(lt_title, '_', ' ') AS lt_title FROM d_linktarget WHERE lt_namespace = 0),
pl AS (SELECT * FROM d_pagelinks WHERE pl_from_namespace = 0),
ti AS (SELECT page_title, min(page_id) AS page_id FROM page GROUP BY page_title),
rt AS (SELECT lt_id, min(page_id) AS page_id FROM lt JOIN ti ON lt_title = page_title GROUP BY lt_id),
links AS (SELECT pl_from AS src, rt.page_id AS dst FROM pl JOIN rt ON pl_target_id = lt_id WHERE pl_from IN (SELECT page_id FROM page))"""
_DUMPS = _with("d_page", "d_linktarget", "d_pagelinks", more=_ARTICLES)


def _search(edges: str, start: str, end: str | None = None) -> str:
    """Distances by a depth-bounded recursion; with an end, every shortest path to it, too."""
    dist = f"""r(node, d) AS (SELECT {start}, 0 UNION SELECT e.dst, r.d + 1 FROM r JOIN {edges} e ON e.src = r.node WHERE r.d < {DEPTH}),
dist AS (SELECT node, min(d) AS dist FROM r GROUP BY node)"""
    if end is None:
        return dist
    return dist + f""",
p(head, left_, path) AS (SELECT node, dist, CAST(node AS VARCHAR) FROM dist WHERE node = {end}
  UNION ALL SELECT e.src, p.left_ - 1, CAST(e.src AS VARCHAR) || ' -> ' || p.path FROM p JOIN {edges} e ON e.dst = p.head JOIN dist ON dist.node = e.src AND dist.dist = p.left_ - 1)"""


def _searched(view_name: str, select: str, end: int | None = None) -> str:
    return _with(view_name, more=_search(view_name, f"CAST({START} AS BIGINT)", None if end is None else str(end)), recursive=True) + select


_FOUND = "SELECT path AS path_text FROM p WHERE left_ = 0"
_TITLED = """, t(head, left_, path) AS (SELECT node, dist, page_title FROM dist JOIN {nodes} n ON n.page_id = node WHERE node = {end}
  UNION ALL SELECT e.src, t.left_ - 1, n.page_title || ' -> ' || t.path FROM t JOIN {edges} e ON e.dst = t.head JOIN dist ON dist.node = e.src AND dist.dist = t.left_ - 1 JOIN {nodes} n ON n.page_id = e.src)
SELECT path AS path_text FROM t WHERE left_ = 0"""


def _values(rows: list[tuple]) -> str:
    cell = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _entity(x: str) -> str:
    """One numeric reference in a value, decimal or hexadecimal."""
    code = f"CASE WHEN regexp_matches({x}, '&#[xX]') THEN CAST('0x' || regexp_extract({x}, '&#[xX]([0-9a-fA-F]+);', 1) AS INTEGER) ELSE CAST(regexp_extract({x}, '&#([0-9]+);', 1) AS INTEGER) END"
    return f"""replace(CASE WHEN contains({x}, '&#') THEN regexp_replace({x}, '&#[^;]*;', chr({code})) ELSE {x} END, '"', '')"""


_STATS = f"""stats AS (SELECT f[3] AS language_code, {_entity('f[2]')} AS language_name, {_entity('f[11]')} AS local_language_name, f[37] AS wiki_id,
  TRY_CAST(f[5] AS INTEGER) AS articles, TRY_CAST(f[8] AS INTEGER) AS users, false AS is_downloaded
  FROM (SELECT string_split(line, ',') AS f FROM (VALUES {_values([(x,) for x in inline.STATS])}) v(line) WHERE line <> '') s
  WHERE len(f) >= 37 AND f[3] <> '' AND TRY_CAST(f[5] AS INTEGER) IS NOT NULL AND TRY_CAST(f[8] AS INTEGER) IS NOT NULL)"""
_FILES = f"""parts AS (SELECT regexp_extract(name, '^(.*?)wiki-', 1) AS language_code, regexp_extract(name, 'wiki-([0-9]{{8}})-', 1) AS date, regexp_extract(name, 'wiki-[0-9]{{8}}-(.*)[.]sql[.]gz$', 1) AS kind, size
  FROM (VALUES {_values(inline.FILES)}) v(name, size) WHERE name LIKE '%wiki-%.sql.gz'),
here AS (SELECT language_code, date, CAST(max(size) FILTER (kind = 'page') AS BIGINT) AS page_size, CAST(max(size) FILTER (kind = 'linktarget') AS BIGINT) AS linktarget_size, CAST(max(size) FILTER (kind = 'pagelinks') AS BIGINT) AS pagelinks_size,
  CAST(sum(size) FILTER (kind IN ('page', 'linktarget', 'pagelinks')) AS BIGINT) AS size_on_disk
  FROM parts GROUP BY ALL HAVING count(DISTINCT kind) FILTER (kind IN ('page', 'linktarget', 'pagelinks')) = 3)"""

_url = lambda t: f"'https://dumps.wikimedia.org/' || wiki_prefix || 'wiki/' || date || '/' || wiki_prefix || 'wiki-' || date || '-{t}.sql.gz' AS {t}_url"

ORACLES: dict[str, str] = {
    "all_shortest_paths": _searched("e_dense", _FOUND, END),
    "all_shortest_paths_multi": _searched("e_dense_multi", _FOUND, END),
    "all_shortest_paths_sparse": _searched("e_sparse", _FOUND, END),
    "count_shortest_paths": _searched("e_dense", f"SELECT CAST((SELECT dist FROM dist WHERE node = {END}) AS INTEGER) AS distance, count(*) AS n_paths FROM p WHERE left_ = 0", END),
    "path_text": _with("e_dense", "n_part", more=_search("e_dense", f"CAST({START} AS BIGINT)"), recursive=True) + _TITLED.format(nodes="n_part", edges="e_dense", end=END),
    "path_same_node": f"SELECT '{START}' AS path_text",
    "path_unreachable": _searched("e_sparse", "SELECT count(*) AS n_paths FROM dist WHERE node = -1"),
    "search_by_title": _with("d_page", "d_linktarget", "d_pagelinks", more=_ARTICLES + ",\nedges AS (SELECT DISTINCT src, dst FROM links),\n" + _search("edges", f"(SELECT page_id FROM ti WHERE page_title = '{FROM_TITLE.strip()}')"), recursive=True) + _TITLED.format(nodes="page", edges="edges", end=f"(SELECT page_id FROM ti WHERE page_title = '{TO_TITLE}')"),
    "path_unreachable_part": _with("n_part", "e_sparse", more=_search("e_sparse", f"CAST({START} AS BIGINT)"), recursive=True) + "SELECT min(page_id) AS target, CAST(0 AS BIGINT) AS n_paths FROM n_part WHERE page_id NOT IN (SELECT node FROM dist)",
    "bfs_distances": _searched("e_sparse", "SELECT node, CAST(dist AS INTEGER) AS dist FROM dist"),
    "reachable_nodes": _searched("e_sparse", "SELECT node FROM dist"),
    "bfs_layers": _searched("e_sparse", "SELECT CAST(dist AS INTEGER) AS dist, count(*) AS layer_size, CAST(sum(count(*)) OVER (ORDER BY dist) AS BIGINT) AS explored FROM dist GROUP BY dist"),
    "shortest_distance": _searched("e_sparse", f"SELECT CAST(dist AS INTEGER) AS distance FROM dist WHERE node = {END}"),
    "shortest_path_dag": _searched("e_sparse", "SELECT src, dst, CAST(a.dist AS INTEGER) AS dist FROM e_sparse JOIN dist a ON a.node = src JOIN dist b ON b.node = dst WHERE b.dist = a.dist + 1"),
    "page_scan": _DUMPS + "SELECT * FROM page",
    "linktarget_scan": _DUMPS + "SELECT * FROM lt",
    "pagelinks_scan": _DUMPS + "SELECT * FROM pl",
    "title_index": _DUMPS + "SELECT * FROM ti",
    "node_index": _DUMPS + "SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS node_index FROM page",
    "resolve_linktargets": _DUMPS + "SELECT * FROM rt",
    "resolve_links": _DUMPS + "SELECT * FROM links",
    "red_links": _DUMPS + "SELECT lt_id, lt_title FROM lt WHERE NOT EXISTS (SELECT 1 FROM ti WHERE page_title = lt_title)",
    "link_stats": _DUMPS + """SELECT (SELECT count(*) FROM lt) AS targets_parsed, (SELECT count(*) FROM lt JOIN ti ON lt_title = page_title) AS targets_mapped, (SELECT count(*) FROM lt WHERE lt_title NOT IN (SELECT page_title FROM ti)) AS title_misses,
  count(*) AS links_parsed, count(*) FILTER (pl_from IN (SELECT page_id FROM page) AND pl_target_id IN (SELECT lt_id FROM rt)) AS links_inserted, count(*) FILTER (pl_from NOT IN (SELECT page_id FROM page)) AS source_misses, count(*) FILTER (pl_target_id NOT IN (SELECT lt_id FROM rt)) AS target_misses FROM pl""",
    "graph_edges": _DUMPS + "SELECT DISTINCT src, dst FROM links",
    "graph_counts": _DUMPS + "SELECT (SELECT count(*) FROM page) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM links) x) AS n_links",
    "out_degree": _with("e_dense") + "SELECT src, count(*) AS out_degree FROM e_dense GROUP BY src",
    "start_out_degree": _with("e_dense") + f"SELECT count(*) AS out_degree FROM e_dense WHERE src = {START}",
    "adjacency": _with("e_dense", "n_part") + "SELECT page_id, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst), '') AS dsts FROM n_part LEFT JOIN e_dense ON src = page_id GROUP BY page_id",
    "title_lookup": _DUMPS + f"SELECT page_id, page_title FROM ti WHERE page_title = '{FROM_TITLE.strip()}'",
    "catalog_stats": f"WITH {_STATS} SELECT * FROM stats",
    "catalog_downloaded": f"WITH {_FILES} SELECT * FROM here",
    "catalog_list": f"""WITH {_STATS},
{_FILES}
SELECT h.language_code, coalesce(s.language_name, '') || ' (' || date || ')' AS language_name, coalesce(s.local_language_name, '') AS local_language_name, true AS is_downloaded FROM here h LEFT JOIN stats s USING (language_code)
UNION ALL SELECT language_code, language_name, local_language_name, is_downloaded FROM stats""",
    "catalog_sizes": f"""WITH {_FILES} SELECT language_code, date, format('{{:,}}', size_on_disk * 100000) AS bytes, printf('%.2f MB', size_on_disk * 100000 / 1048576.0) AS megabytes, printf('%.1f%%', 100.0 * page_size / size_on_disk) AS page_share, CAST(0 AS DOUBLE) AS of_nothing FROM here""",
    "bfs_progress": _with("e_sparse", "n_part", more=_search("e_sparse", f"CAST({START} AS BIGINT)"), recursive=True) + """SELECT CAST(dist AS INTEGER) AS dist, printf('%.1f%%', 100.0 * n / s) AS layer_share, round(CAST(s AS DOUBLE) / (SELECT count(*) FROM n_part), 6) AS graph_share
  FROM (SELECT dist, count(*) AS n, sum(count(*)) OVER (ORDER BY dist) AS s FROM dist GROUP BY dist) x""",
    **written.ORACLES,
    "dump_pagelinks": _with("e_dense") + "SELECT src AS pl_from, 0 AS pl_from_namespace, dst + 1000000 AS pl_target_id FROM e_dense WHERE src % 17 = 0 AND src % 101 <> 7",
    "dump_urls": f"""SELECT wiki_prefix, date, {_url('page')}, {_url('pagelinks')}, {_url('linktarget')} FROM (SELECT wiki_prefix, regexp_extract(regexp_extract(rss, '<link>([^<]+)</link>', 1), '[^/]*$') AS date FROM (VALUES {_values(inline.FEEDS)}) v(wiki_prefix, rss)) x""",
}
