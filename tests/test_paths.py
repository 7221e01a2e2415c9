"""Golden micro-graphs and properties of searches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hopweave.operators import paths as walk
from hopweave.operators.graph import BlankTitle, LinkGraph, UnknownTitle
from hopweave.operators.paths import bfs_layers, path_titles, shortest_path_dag
from hopweave.plans.fixtures import view


def graph(spark, edges, nodes=None) -> LinkGraph:
    ids = sorted({x for e in edges for x in e} | set(nodes or ()))
    return LinkGraph(spark.createDataFrame([(i, f"N{i}", False) for i in ids], "page_id long, page_title string, page_is_redirect boolean"), spark.createDataFrame(edges, "src long, dst long")).stored()


DIAMOND = [(1, 2), (1, 3), (2, 4), (3, 4)]
CASES = {
    "same": ([(1, 2)], 1, 1, [[1]]),
    "line": ([(1, 2), (2, 3)], 1, 3, [[1, 2, 3]]),
    "diamond": (DIAMOND, 1, 4, [[1, 2, 4], [1, 3, 4]]),
    "shortcut": ([*DIAMOND, (1, 4)], 1, 4, [[1, 4]]),
    "cycle": ([(1, 1), (1, 2), (2, 1), (2, 3)], 1, 3, [[1, 2, 3]]),
    "directed": ([(1, 2)], 2, 1, []),
    "parallel": ([(1, 2), (1, 2), (2, 3)], 1, 3, [[1, 2, 3]] * 2),
    "isolated": ([(1, 2)], 1, 9, []),
    "unknown": ([(1, 2)], 7, 8, []),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name):
    edges, start, end, want = CASES[name]
    g = graph(spark, edges, [9] if name == "isolated" else None)
    assert sorted(r["path"] for r in g.all_shortest_paths(start, end).collect()) == want
    row = g.count_shortest_paths(start, end).first()
    assert row["n_paths"] == len(want) and row["distance"] == (len(want[0]) - 1 if want else None)


def test_adjacency_and_degrees(spark):
    g = graph(spark, [(1, 2), (1, 1)], [9])
    assert {r["page_id"]: r["dsts"] for r in g.adjacency().collect()} == {1: [1, 2], 2: [], 9: []}
    assert g.degree_of(9).first()["out_degree"] == 0
    assert g.counts().first().asDict() == {"n_nodes": 3, "n_links": 2}
    assert [tuple(r) for r in g.node_index().orderBy("page_id").collect()] == [(1, 0), (2, 1), (9, 2)]


def test_search_by_title(spark):
    g = graph(spark, [(1, 2), (2, 3)])
    assert [r["path_text"] for r in g.search(" N1\n", "N3").collect()] == ["N1 -> N2 -> N3"]
    with pytest.raises(BlankTitle):
        g.search(" \t", "N3")
    with pytest.raises(UnknownTitle):
        g.search("N1", "n3")


def test_first_page_owns_a_title(spark):
    pages = spark.createDataFrame([(1, "S", False), (8, "A", False), (5, "A", True)], "page_id long, page_title string, page_is_redirect boolean")
    targets = spark.createDataFrame([(70, "A"), (71, "Red")], "lt_id long, lt_title string")
    links = spark.createDataFrame([(1, 70), (1, 71), (99, 70)], "pl_from long, pl_target_id long")
    g = LinkGraph.build(pages, targets, links)
    assert [tuple(r) for r in g.edges.collect()] == [(1, 5)]
    assert g.all_shortest_paths(1, 5).count() == 1 and g.all_shortest_paths(1, 8).count() == 0


def test_layers_and_paths_hold_together(spark, sf_dir):
    g = LinkGraph(view(spark, sf_dir, "n_part"), view(spark, sf_dir, "e_sparse")).stored()
    layers = g.bfs(0)
    assert layers.sizes == [1, 1, 3, 10, 22, 39, 56, 35, 15, 4, 1, 1]
    assert [r["explored"] for r in bfs_layers(layers, spark).orderBy("dist").collect()][-1] == 188
    edges = {tuple(r) for r in g.edges.collect()}
    dist = {r["node"]: r["dist"] for r in layers.dist.collect()}
    assert all(dist[b] == dist[a] + 1 for a, b, _ in shortest_path_dag(g.edges, layers).collect())
    paths = [tuple(r["path"]) for r in g.all_shortest_paths(0, 77).collect()]
    assert paths and len(set(paths)) == len(paths) and all(len(p) - 1 == dist[77] and all(e in edges for e in zip(p, p[1:], strict=False)) for p in paths)


def test_titles_keep_order_of_a_repeated_path(spark):
    g = graph(spark, [(1, 2), (1, 2), (2, 3)])
    rows = path_titles(g.all_shortest_paths(1, 3), g.nodes).collect()
    assert [r["titles"] for r in rows] == [["N1", "N2", "N3"]] * 2


def test_counts_beyond_a_long(spark):
    """A chain of 16 diamonds with 16 middles each has 2^64 paths."""
    edges = [e for k in range(16) for m in range(1, 17) for e in ((17 * k, 17 * k + m), (17 * k + m, 17 * k + 17))]
    row = graph(spark, edges).count_shortest_paths(0, 272).first()
    assert row["distance"] == 32 and int(row["n_paths"]) == 2**64


@pytest.mark.parametrize("most", [0, 500])
def test_frontiers_as_lists_and_as_tables(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(walk, "LITERALS", most)
    g = LinkGraph(view(spark, sf_dir, "n_part"), view(spark, sf_dir, "e_dense")).stored()
    assert g.count_shortest_paths(0, 77).first()["n_paths"] == g.all_shortest_paths(0, 77).count() == 4


def test_edges_stay_in_their_buckets(spark, sf_dir):
    """A layer's plan moves no edge, and prunes by literal sources."""
    g = LinkGraph(view(spark, sf_dir, "n_part"), view(spark, sf_dir, "e_dense")).stored()
    frontier = g.nodes.select(F.col("page_id").alias("node")).hint("merge")
    plan = g.edges.join(frontier, F.col("src") == F.col("node"), "left_semi")._jdf.queryExecution().executedPlan().toString()
    scan = plan[: plan.index("Scan parquet spark_catalog")]
    assert "SortMergeJoin" in plan and scan.count("Exchange") == 0
    pruned = walk._touching(g.edges, "src", spark.createDataFrame([(3,)], "node long"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 4" in pruned and "In(src" in pruned or "EqualTo(src" in pruned


def test_saved_graphs_open_again(spark, tmp_path):
    g = graph(spark, [(1, 2), (2, 3), (1, 3)])
    g.save(str(tmp_path / "g"))
    again = LinkGraph.open(spark, str(tmp_path / "g"))
    assert again.counts().first().asDict() == {"n_nodes": 3, "n_links": 3}
    assert [r["path"] for r in again.all_shortest_paths(1, 3).collect()] == [[1, 3]]
