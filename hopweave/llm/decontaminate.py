"""Benchmark decontamination by size-partitioned MinHash containment search (operator 7).

Only DataFrame functions: no Python runs on the executors.

An item's containment in a document is the share of the item's distinct
five-word shingles that the document has. Only shingles that some item has
matter for it, so a document is first reduced to those (a join of shingle
hashes with the benchmark's, broadcast after its size is checked). Documents
with the same reduced set are one class, and so are items with the same set, so
a passage that many documents or items repeat is met once. Then, as in a
containment ensemble:

- classes and items are partitioned by set size (powers of two);
- for a pair of partitions the containment threshold t gives a least Jaccard
  similarity, t*q / (u + q - t*q) with q the item's size and u the upper size of
  the class's partition, and with it the number of minhash rows a band may have
  for the chance of a miss to stay below MISS; both sides emit band keys for
  the partitions they are searched with;
- partitions so far apart in size that HASHES one-row bands can't hold that
  bound are searched by their shingles themselves (exact, and selective: such
  an item is tiny against what the document shares with the benchmark).

Candidates are verified by exact shingle containment. A shingle's identity is
the 64-bit hash of its words.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import dropped, small, stored, table
from .textkit import SHINGLE_WORDS

PERCENT = 75
HASHES = 96
MISS = 1e-6
#: Benchmark shingles (hash and item id, 16 bytes) that a broadcast may hold; more are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000
_MAX_CLASS = 40


def shingled(rows: DataFrame, key: str) -> DataFrame:
    """(key, text) -> a row for each shingle: key and the hash h of lower-cased words between white space, five at a time, or all of fewer.

    The word hashes pass through a one-row explode, which keeps the optimiser
    from working them out again for every shingle.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.explode(F.array(F.transform(words, lambda w: F.xxhash64(w)))).alias("w"))
    n = F.size("w")
    beside = F.arrays_zip(*[F.slice("w", k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(SHINGLE_WORDS)])
    many = F.slice(F.transform(beside, lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(SHINGLE_WORDS)])), 1, n - (SHINGLE_WORDS - 1))
    return w.where(n > 0).select(key, F.explode(F.when(n >= SHINGLE_WORDS, many).otherwise(F.array(F.xxhash64("w")))).alias("h"))


def _levels(size: Column) -> Column:
    """The size partition: k for sizes from 2^(k-1)+1 to 2^k."""
    return F.ceil(F.log2(size.cast("double")) - 1e-9).cast("int")


def rows_of_band(item_level: int, class_level: int) -> int:
    """Rows a band may have between two partitions; 0 where they are searched by shingles."""
    t = PERCENT / 100
    q = 2 ** (item_level - 1) + 1 if item_level else 1  # the least item of its partition is the hardest
    u = 2**class_level
    if u < t * q:
        return -1  # too small a class to hold the item
    j = t * q / (u + q - t * q) if u + q - t * q > 0 else 1.0
    best = 0
    for r in (1, 2, 3, 4):
        bands = HASHES // r
        if min(j, 1.0) >= 1.0 or bands * log(1 - min(j, 0.999999) ** r) <= log(MISS):
            best = r
    return best


def _signature(shingles: Column) -> Column:
    """HASHES minhashes of a set of hashes."""

    def least(k: int) -> Column:  # a lambda with two arguments would be given the index
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*[least(k) for k in range(HASHES)])


def _bands(signature: Column, r: Column) -> Column:
    """Keys of the bands of r rows."""
    return F.transform(F.sequence(F.lit(0), (F.floor(F.lit(HASHES) / r) - 1).cast("int")), lambda b: F.xxhash64(r, b, F.slice(signature, (b * r + 1).cast("int"), r)))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text, ...) and (item_id, text, ...) -> doc_id, item_id, n_shared, n_item, containment of every pair at 0.75 or more.

    A document's id stands for the document: rows that repeat an id are read as
    one. Null ids, null and blank texts are in no pair. An item of fewer than
    five words is one shingle of them all, found only as a whole short text.
    Repeated items are each reported. Words are split at ASCII white space and
    lower-cased. Very long texts are read whole; other columns aren't read; an
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    bench = stored(shingled(items, "item_id").distinct(), "bench")
    known = stored(bench.select("h").distinct(), "known")
    hits = shingled(docs, "doc_id").join(small(known, BROADCAST_SHINGLES), "h")
    reduced = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("h")).alias("own"))
    reduced = stored(reduced.select("doc_id", "own", F.xxhash64("own").alias("d1"), F.xxhash64(F.lit(1), "own").alias("d2")), "reduced")
    classes = stored(reduced.groupBy("d1", "d2").agg(F.first("own").alias("own")).withColumn("n", F.size("own")).withColumn("level", _levels(F.col("n"))), "classes")
    each = bench.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("want"))
    each = stored(each.select("item_id", "want", F.xxhash64("want").alias("i1"), F.xxhash64(F.lit(1), "want").alias("i2")), "each")
    wanted = stored(each.groupBy("i1", "i2").agg(F.min("item_id").alias("item"), F.first("want").alias("want")).withColumn("q", F.size("want")).withColumn("item_level", _levels(F.col("q"))), "items")
    member = stored(each.select("item_id", "i1", "i2").join(wanted.select("i1", "i2", "item"), ["i1", "i2"]).select("item_id", "item"), "member")

    plan = [(a, b, rows_of_band(a, b)) for a in range(_MAX_CLASS) for b in range(_MAX_CLASS)]
    plan = spark.createDataFrame([x for x in plan if x[2] >= 0], "item_level int, level int, r int")  # fixed: at most 1,600 rows
    mine = classes.select("level").distinct()
    banded = stored(plan.join(wanted.select("item_level").distinct(), "item_level").join(mine, "level"), "levels")
    signed_items = stored(wanted.withColumn("sig", _signature(F.col("want"))), "signed")
    signed = stored(classes.join(F.broadcast(banded.where("r > 0").select("level").distinct()), "level", "left_semi").withColumn("sig", _signature(F.col("own"))), "signed")
    left = signed_items.join(F.broadcast(banded.where("r > 0")), "item_level").select("item", "level", F.explode(_bands(F.col("sig"), F.col("r"))).alias("key"))
    left = stored(left.distinct(), "bands")
    right = signed.join(F.broadcast(banded.where("r > 0").select("level", "r").distinct()), "level").select("d1", "d2", "level", F.explode(_bands(F.col("sig"), F.col("r"))).alias("key"))
    near = right.join(small(left), ["level", "key"]).select("d1", "d2", "item")
    far = classes.join(F.broadcast(banded.where("r = 0").select("level").distinct()), "level", "left_semi").select("d1", "d2", "level", F.explode("own").alias("h"))
    tiny = stored(wanted.join(F.broadcast(banded.where("r = 0")), "item_level").select("item", "level", F.explode("want").alias("h")), "tiny")
    candidates = stored(near.unionByName(far.join(small(tiny), ["level", "h"]).select("d1", "d2", "item")).distinct(), "candidates")

    pairs = candidates.join(classes.select("d1", "d2", "own"), ["d1", "d2"]).join(wanted.select("item", "want", "q"), "item")
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect("own", "want"))).where(F.col("n_shared") * 100 >= F.col("q") * PERCENT)
    found = stored(pairs.select("d1", "d2", "item", F.col("n_shared").cast("long").alias("n_shared"), F.col("q").cast("long").alias("n_item")).join(small(member), "item").drop("item"), "found")
    dropped(bench, known, classes, each, wanted, banded, signed_items, signed, left, tiny, candidates, member)
    return reduced.select("doc_id", "d1", "d2").join(small(found), ["d1", "d2"]).select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of documents that hold no benchmark item; rows without an id stay."""
    leaks = stored(contained(docs, items).select("doc_id").distinct(), "leaks")
    return docs.join(small(leaks), "doc_id", "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _shingles_sql(table_: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table_} WHERE {key} IS NOT NULL) t"""


#: Containment by the shingles themselves.
ORACLE = f"""WITH d AS ({_shingles_sql("documents", "doc_id")}),
i AS ({_shingles_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, CAST(count(*) AS DOUBLE) / n_item AS containment FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item"""
