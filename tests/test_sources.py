"""Dump files, catalog files and scalar functions."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from hopweave.functions import text as tx
from hopweave.operators.graph import LinkGraph
from hopweave.operators.load import MissingDump, load, searched
from hopweave.plans import inline
from hopweave.sources import dumps, wikis
from hopweave.streaming import dumps as streamed

SAMPLE = (
    "-- a comment\n"
    r"INSERT INTO `page` VALUES (1,0,'Plain_Title',0,0),(2,0,'O\'Reilly_Media',1,0),(3,0,'Say_\"Hi\"',0,0),(4,0,'Odd_(a),(b)',0,0),(5,1,'Talk',0,0),(6,0,'Back\\slash',0,0),(7,-1,'Neg',0,0),(8,0,'Zoë',0,0);"
    "\n"
    r"INSERT INTO `page` VALUES (9,0,'Say_Hi',0,0),(10,0,'Later',0,'x (11,0,\'Ghost\',0)');"
)


@pytest.fixture
def dump(tmp_path):
    path = tmp_path / "xxwiki-20250801-page.sql.gz"
    path.write_bytes(gzip.compress(SAMPLE.encode()))
    return str(path)


def test_strict_titles(spark, dump):
    rows = {r["page_id"]: r["page_title"] for r in dumps.scan(spark, dump, "page").collect()}
    assert rows == {1: "Plain Title", 2: "O'Reilly Media", 3: 'Say "Hi"', 4: "Odd (a),(b)", 6: "Back\\slash", 8: "Zoë", 9: "Say Hi", 10: "Later"}


def test_compat_titles(spark, dump):
    rows = {r["page_id"]: r["page_title"] for r in dumps.scan(spark, dump, "page", "compat").collect()}
    assert rows == {1: "Plain Title", 3: "Say Hi", 6: "Back\\slash", 8: "Zoë", 9: "Say Hi", 10: "Later"}


def test_one_row_for_each_tuple_and_parquet(spark, dump, tmp_path):
    got = dumps.materialized(spark, dump, str(tmp_path / "page"), "page")
    assert got.count() == got.select("page_id").distinct().count() == 8
    assert [r["page_id"] for r in got.where("page_is_redirect").collect()] == [2]


def test_links_and_targets(spark, tmp_path):
    (tmp_path / "l.sql").write_text("INSERT INTO `pagelinks` VALUES (1,0,18446744073709551615),(2,0,5),(3,1,5),(4294967296,0,5);\n")
    (tmp_path / "t.sql").write_text("INSERT INTO `linktarget` VALUES (5,0,'A_b'),(6,-1,'N'),(7,4,'P');\n")
    assert [tuple(r) for r in dumps.scan(spark, str(tmp_path / "l.sql"), "pagelinks").collect()] == [(2, 0, 5)]
    assert [tuple(r) for r in dumps.scan(spark, str(tmp_path / "t.sql"), "linktarget").collect()] == [(5, 0, "A b")]
    with pytest.raises(ValueError):
        dumps.scan(spark, str(tmp_path / "l.sql"), "pagelinks", "other")


def test_stream_of_arriving_dumps(spark, dump, tmp_path):
    target, at = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second run finds nothing new
        streamed.append(streamed.stream(spark, str(tmp_path), "page"), target, at).awaitTermination()
    assert spark.read.parquet(target).count() == 8


@pytest.mark.parametrize(
    ("text", "want"),
    [("&#x41;&#66;c", "ABc"), ("&#233;t&#xe9;", "été"), ("&#128512;", "😀"), ("no &amp; name", "no &amp; name"), ("a &# b", "a &# b"), ("&#;x", None), ("&#zz;", None), ("&#38;#65;", "&#65;"), ("&#x20AC;", "€"), ("", "")],
)
def test_entities(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.entities_decoded(F.col("t"))).first()[0] == want


def test_scalars(spark):
    row = spark.range(1).select(
        tx.trimmed(F.lit(" \t a b\n")), tx.unsigned(F.lit("4294967296")), tx.unsigned(F.lit("-1")), tx.leading_int(F.lit(" 12x")), tx.leading_int(F.lit("99999999999")), tx.flag(F.lit("2")), tx.flag(F.lit("0")), tx.spaced(F.lit("a_b"))
    ).first()
    assert tuple(row) == ("a b", None, None, 12, None, True, False, "a b")


def test_feed_without_an_address(spark):
    feeds = spark.createDataFrame([("en", "<rss></rss>")], "wiki_prefix string, rss string")
    with pytest.raises(Exception, match="no download address in the feed of en"):
        wikis.dump_urls(feeds).collect()


def test_formats(spark):
    row = spark.range(1).select(tx.thousands(F.lit(1234567)), tx.megabytes(F.lit(3 << 19)), tx.ratio(F.lit(1), F.lit(4)), tx.ratio(F.lit(1), F.lit(0)), tx.ratio(F.lit(1), F.lit(None).cast("long")), tx.percent(F.lit(0.256))).first()
    assert tuple(row) == ("1,234,567", "1.50 MB", 0.25, 0.0, 0.0, "25.6%")


def test_load_in_one_call(spark, dump, tmp_path):
    """From three files to a search, and the same graph opened again."""
    for kind, line in (("linktarget", "INSERT INTO `linktarget` VALUES (70,0,'Zoë'),(71,0,'Later');"), ("pagelinks", "INSERT INTO `pagelinks` VALUES (1,0,70),(8,0,71);")):
        (tmp_path / f"xxwiki-20250801-{kind}.sql.gz").write_bytes(gzip.compress((line + "\n").encode()))
    graph, took = load(spark, str(tmp_path), "xx", "20250801", str(tmp_path / "out"))
    assert [r["path_text"] for r in searched(graph, "Plain Title", "Later", took).collect()] == ["Plain Title -> Zoë -> Later"]
    assert set(took.ms) == {"page", "linktarget", "pagelinks", "build", "search"} and took.load_total == sum(took.ms.values()) - took.ms["search"]
    assert LinkGraph.open(spark, str(tmp_path / "out" / "graph")).counts().first()["n_links"] == 2
    with pytest.raises(MissingDump):
        load(spark, str(tmp_path), "yy", "20250801", str(tmp_path / "out"))


def test_catalog(spark, tmp_path):
    lines = spark.createDataFrame([(x,) for x in inline.STATS], "value string")
    online = wikis.stats(lines)
    assert [r["language_code"] for r in online.collect()] == ["en", "fr", "de", "simple", "uk"]
    assert {r["language_code"]: r["local_language_name"] for r in online.collect()}["fr"] == "Français"
    (tmp_path / "stats.csv").write_text("\n".join(["header", *inline.STATS]))
    assert wikis.read_stats(spark, str(tmp_path / "stats.csv")).count() == 5
    for name in ("aawiki-20250101-page.sql.gz", "aawiki-20250101-linktarget.sql.gz", "aawiki-20250101-pagelinks.sql.gz", "bbwiki-20250101-page.sql.gz"):
        (tmp_path / name).write_bytes(b"1234")
    here = wikis.downloaded(wikis.listing(spark, str(tmp_path)))
    assert [(r["language_code"], r["size_on_disk"]) for r in here.collect()] == [("aa", 12)]
    assert [r["language_name"] for r in wikis.catalog(here, None).collect()] == ["aawiki (20250101)"]
    names = [r["language_name"] for r in wikis.catalog(here, online).collect()]
    assert " (20250101)" in names and len(names) == 6
    empty = wikis.catalog(here.limit(0), online.limit(0)).collect()
    assert [r["language_name"] for r in empty] == [wikis.NO_WIKIS]
