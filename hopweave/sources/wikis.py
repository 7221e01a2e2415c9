"""The catalog of wikis: statistics, dump files at hand, and where the latest dumps are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entities_decoded, leading_int

# The file types a wiki needs, the positions of the statistics' columns, and the addresses of dumps.
FILE_TYPES = ("page", "linktarget", "pagelinks")
FIELDS = {"language_name": 1, "language_code": 2, "articles": 4, "users": 7, "local_language_name": 10, "wiki_id": 36}
WIDTH = 37
DUMP_URL = "https://dumps.wikimedia.org/%swiki/%s/%swiki-%s-{}.sql.gz"
NO_WIKIS = "No wikis available"


def stats(lines: DataFrame) -> DataFrame:
    """Statistics lines (value; header left out) -> a row for each wiki, by users descending.

    Commas cut always, quotes or not, and a trailing empty field doesn't count.
    Lines too short, without language code, or whose numbers or references
    don't parse are left out.
    """
    f = lines.where(F.length("value") > 0).select(F.split(F.regexp_replace("value", ",$", ""), ",").alias("f")).where(F.size("f") >= WIDTH)
    named = {k: F.col("f")[i] for k, i in FIELDS.items()}
    out = f.select(
        named["language_code"].alias("language_code"), *[F.replace(entities_decoded(named[k]), F.lit('"'), F.lit("")).alias(k) for k in ("language_name", "local_language_name")], named["wiki_id"].alias("wiki_id"),
        *[leading_int(named[k]).alias(k) for k in ("articles", "users")], F.lit(False).alias("is_downloaded"),
    )
    return out.where("language_code <> '' and language_name is not null and local_language_name is not null and articles is not null and users is not null").orderBy(F.desc("users"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """A statistics file: its first line is the header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return stats(lines.where("n > 0").select("value"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Dump files of a folder: file_name, file_size. Only names and sizes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sql.gz").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("file_size"))


def downloaded(files: DataFrame) -> DataFrame:
    """(file_name, file_size) -> complete wikis: language_code, date, one size for each type, size_on_disk; by code and date.

    A name is `<code>wiki-<YYYYMMDD>-<type>.sql.gz`; others are left out, and so
    is a wiki that lacks one of the three files. Of repeated files one counts.
    """
    name = F.col("file_name")
    at = F.locate("wiki-", name)
    parts = files.where(name.endswith(".sql.gz") & (at > 0)).select(
        F.substr(name, F.lit(1), at - 1).alias("language_code"), F.substr(name, at + 5, F.lit(8)).alias("date"), F.substr(name, at + 14, F.locate(".sql.gz", name) - at - 14).alias("file_type"), "file_size",
    )
    sizes = parts.where(F.col("file_type").isin(*FILE_TYPES)).groupBy("language_code", "date").pivot("file_type", list(FILE_TYPES)).agg(F.max("file_size"))
    complete = sizes.where(" and ".join(f"{t} is not null" for t in FILE_TYPES))
    return complete.select("language_code", "date", *[F.col(t).cast("long").alias(f"{t}_size") for t in FILE_TYPES], (F.col("page") + F.col("linktarget") + F.col("pagelinks")).cast("long").alias("size_on_disk")).orderBy("language_code", "date")


def catalog(here: DataFrame, online: DataFrame | None) -> DataFrame:
    """Downloaded wikis with their names and date, then all online ones; a placeholder row where there are none.

    online None: offline, names are made from the code. A code that the
    statistics hold twice counts once (the entry with fewest users, which comes
    last in their order); one they lack has empty names.
    """
    columns = ["language_code", "language_name", "local_language_name", "is_downloaded"]
    if online is None:
        mine = here.select("language_code", F.format_string("%swiki (%s)", "language_code", "date").alias("language_name"), F.lit("").alias("local_language_name"), F.lit(True).alias("is_downloaded"))
        both = mine
    else:
        names = online.groupBy("language_code").agg(F.min_by(F.struct("language_name", "local_language_name"), F.struct("users", "language_name")).alias("s"))
        text = lambda k: F.coalesce(F.col("s")[k], F.lit(""))
        mine = here.join(names, "language_code", "left").select("language_code", F.concat(text("language_name"), F.lit(" ("), F.col("date"), F.lit(")")).alias("language_name"), text("local_language_name").alias("local_language_name"), F.lit(True).alias("is_downloaded"))
        both = mine.unionByName(online.select(*columns))
    none = both.sparkSession.range(1).select(F.lit("").alias("language_code"), F.lit(NO_WIKIS).alias("language_name"), F.lit("").alias("local_language_name"), F.lit(False).alias("is_downloaded"))
    counted = none.crossJoin(both.agg(F.count("*").alias("n"))).where("n = 0").drop("n")  # two single rows
    return both.unionByName(counted)


def dump_urls(feeds: DataFrame) -> DataFrame:
    """(wiki_prefix, rss) -> wiki_prefix, date and the three addresses of the dump that the feed's first link names.

    A feed without a link has no addresses: reading its row raises.
    """
    link = F.regexp_extract(F.coalesce("rss", F.lit("")), "<link>([^<]+)</link>", 1)
    missing = F.raise_error(F.concat(F.lit("no download address in the feed of "), F.coalesce("wiki_prefix", F.lit("an unnamed wiki"))))
    date = F.when(link == "", missing.cast("string")).otherwise(F.substring_index(link, "/", -1))
    dated = feeds.select("wiki_prefix", date.alias("date"))
    address = lambda t: F.format_string(DUMP_URL.format(t), "wiki_prefix", "date", "wiki_prefix", "date").alias(f"{t}_url")
    return dated.select("wiki_prefix", "date", *[address(t) for t in ("page", "pagelinks", "linktarget")])
