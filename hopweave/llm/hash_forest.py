"""Approximate nearest neighbours by a forest of sorted hash strings (operator 5).

Each of TREES trees gives every vector a string of BITS hyperplane bits and
keeps the strings sorted. A query descends to its longest matching prefix in
each tree, then all trees ascend together, one bit at a time, and every level
adds the rows whose strings share that shorter prefix.

How far a query ascends follows from what it finds, not from the table's size.
Two vectors at an angle a share a prefix of L bits in one tree with probability
(1 - a/pi)^L, so a neighbour that near is met by no tree with probability
(1 - (1 - a/pi)^L)^TREES. The first pass ascends in every part until FIRST rows
are met; the k-th best of all of them bounds the angle of the true k nearest
from above. The second pass ascends to the longest prefix at which a neighbour
at that angle is missed with probability MISS at most, down to the whole table
if need be. Near neighbours need long prefixes and few rows, far ones (random
vectors of many dimensions) a large share, which falls as the table grows.

On Spark rows are dealt by a hash into parts that one task can hold, queries
into blocks, and every part meets every block. A part builds its trees itself,
so a pass moves each vector once a block, and no codes at all:

1. vectors of one direction are one row with their smallest ids (ties go to the
   smaller id, so no other copy can be in a result); vectors of another
   dimension are another forest;
2. both passes score their candidates exactly (queries of one prefix together)
   and hand on each part's k best, with all that tie with the last;
3. a last aggregation keeps the best of all parts, and their scores are worked
   out anew, one dot product a pair, from the vectors themselves.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import dropped, mapped, ship, small, stored, table, tidy

TREES, BITS, NEAREST, EVERY = 48, 24, 5, 50
#: Rows of a part that the first pass looks at for each query, and the chance that the second misses a neighbour as near as those found.
FIRST, MISS = 400, 0.07
#: Bytes of vectors of a part and of a block of queries; smaller tables are cut into SPREAD parts of SMALL_BYTES at least, so that all cores work.
PART_BYTES, SMALL_BYTES, SPREAD = 32 << 20, 1 << 20, 24
#: Scores that are held at once.
_SCORES = 1 << 20
#: Scores that differ by less are taken as ties until they are worked out anew.
EPSILON = 1e-9
SEED = 20


def planes(dimension: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, trees * bits)).astype(np.float32)


def codes(x: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(n, d) directions -> (n, trees) strings of bits as numbers."""
    p = planes(x.shape[1], trees, bits)
    out = np.empty((len(x), trees), dtype=np.int32)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.float32)  # sums below 2^24 are whole in single precision
    for at in range(0, len(x), 1000):
        some = x[at : at + 1000].astype(np.float32)
        out[at : at + 1000] = ((some @ p) > 0).reshape(len(some), trees, bits).astype(np.float32) @ weights
    return out


def level_for(score: np.ndarray, trees: int = TREES, bits: int = BITS, miss: float = MISS) -> np.ndarray:
    """The longest prefix at which a vector of that cosine is in no tree's range with probability `miss` at most."""
    agree = 1 - np.arccos(np.clip(score, -1, 1)) / np.pi
    need = 1 - miss ** (1 / trees)  # of one tree
    with np.errstate(divide="ignore"):
        length = np.where(agree <= 0, 0, np.where(agree >= 1, bits, np.floor(log(need) / np.log(np.clip(agree, 1e-12, 1 - 1e-12)))))
    return np.clip(length, 0, bits).astype(np.int64)


class Forest:
    """The trees over one part's rows."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.x, self.trees, self.bits = x, trees, bits
        every = codes(x, trees, bits)
        self.order = np.argsort(every, axis=0, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(every, self.order, axis=0)

    def ranges(self, tree: int, asked: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each code's prefix of its level begins and ends in a tree."""
        shift = self.bits - level
        low = (asked.astype(np.int64) >> shift) << shift
        own = self.codes[:, tree]
        return np.searchsorted(own, low), np.searchsorted(own, low + (np.int64(1) << shift))

    def first_levels(self, asked: np.ndarray, rows: int) -> np.ndarray:
        """The synchronous ascent: the longest prefix at which all trees together offer so many rows (repeats included)."""
        level = np.full(len(asked), self.bits, dtype=np.int64)
        open_ = np.arange(len(asked))
        while len(open_):
            met = np.zeros(len(open_), dtype=np.int64)
            for t in range(self.trees):
                a, b = self.ranges(t, asked[open_, t], level[open_])
                met += b - a
            open_ = open_[(met < rows) & (level[open_] > 0)]
            level[open_] -= 1
        return level

    def best(self, y: np.ndarray, asked: np.ndarray, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The k best rows of each query's ranges, with all that tie with the last: query, row, score; and how many rows were scored."""
        found_q, found_r, found_s, looked = [], [], [], 0
        for t in range(self.trees):
            begin, end = self.ranges(t, asked[:, t], level)
            xt = self.x[self.order[:, t]]
            together = np.lexsort((end, begin))  # queries of one range stand together
            cuts = np.flatnonzero(np.diff(begin[together]) | np.diff(end[together])) + 1
            for group in np.split(together, cuts):
                if not len(group) or begin[group[0]] == end[group[0]]:
                    continue
                a, b = int(begin[group[0]]), int(end[group[0]])
                looked += (b - a) * len(group)
                step = max(1, _SCORES // (b - a))
                for some in (group[i : i + step] for i in range(0, len(group), step)):
                    score = y[some] @ xt[a:b].T
                    n = min(b - a, k)
                    edge = np.partition(score, score.shape[1] - n, axis=1)[:, -n, None]
                    which, place = np.nonzero(score >= edge - EPSILON)
                    found_q.append(some[which])
                    found_r.append(self.order[a + place, t])
                    found_s.append(score[which, place])
            if t % 8 == 7 or t == self.trees - 1:  # keep what may still be among the best
                q, r, s = (np.concatenate(x) if x else np.zeros(0, dtype=d) for x, d in ((found_q, np.int64), (found_r, np.int64), (found_s, np.float64)))
                order = np.lexsort((-s, r, q))
                q, r, s = q[order], r[order], s[order]
                one = np.ones(len(q), dtype=bool)
                one[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])  # a row that several trees offer
                q, r, s = q[one], r[one], s[one]
                order = np.lexsort((-s, q))
                q, r, s = q[order], r[order], s[order]
                first = np.searchsorted(q, q)
                last = np.minimum(first + k - 1, np.searchsorted(q, q, side="right") - 1)
                good = s >= s[last] - EPSILON
                found_q, found_r, found_s = [q[good]], [r[good]], [s[good]]
        return found_q[0], found_r[0], found_s[0], looked


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int, wide: bool) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8" if wide else "<f4").reshape(-1, dimension)


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, whatever the scale."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(wide: bool):
    """Vectors' bytes and a digest of their direction; those null, zero or with null or non-finite components go."""
    import hashlib

    kind = "<f8" if wide else "<f4"

    def run(batches):
        for b in batches:
            ids, raw, one, two = [], [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(x).all() and x.any():
                    y = x.astype(np.float64)
                    d = hashlib.blake2b((y / np.abs(y).max() + 0.0).tobytes(), digest_size=16).digest()
                    ids.append(i)
                    raw.append(x.tobytes())
                    one.append(int.from_bytes(d[:8], "little", signed=True))
                    two.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["vec_id", "v", "d1", "d2"])

    return run


def _searcher(wide: bool, trees: int, bits: int, k: int, first: int):
    """One part and one block: what the queries find there, to their level, or without one in a first ascent."""

    def run(t: pa.Table) -> pa.Table:
        rows, asks = t.filter(t.column("index")), t.filter(t.column("query"))
        if not rows.num_rows or not asks.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dimension = len(rows.column("v")[0].as_py()) // (8 if wide else 4)
        forest = Forest(_units(_matrix(rows.column("v"), dimension, wide)), trees, bits)
        row_ids, ask_ids = rows.column("row").to_numpy(), asks.column("row").to_numpy()
        out = []
        for at in range(0, asks.num_rows, 2000):
            some = asks.slice(at, 2000)
            y = _units(_matrix(some.column("v"), dimension, wide))
            asked = codes(y, trees, bits)
            level = some.column("level").to_numpy()
            if level[0] < 0:
                level = forest.first_levels(asked, first)
            q, r, s, _ = forest.best(y, asked, level, k)
            out.append((ask_ids[at + q], row_ids[r], s))
        q, r, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": pa.array(q), "row": pa.array(r), "score": pa.array(s)})

    return run


def _cosines(wide: bool):
    """The score of each pair from the vectors, the same whatever the order of rows: one dot product a pair."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = ([np.frombuffer(v, dtype="<f8" if wide else "<f4") for v in b.column(c).to_pylist()] for c in ("qv", "v"))
                score = [float((_units(p[None])[0] * _units(q[None])[0]).sum()) for p, q in zip(x, y, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("row"), pa.array(score, pa.float64())], names=["query", "row", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, and all that tie with the last."""
    by = Window.partitionBy("query")
    place = F.row_number().over(by.orderBy(F.desc("score"), "row"))
    edge = F.max(F.when(F.col("place") == k, F.col("score"))).over(by)
    return found.withColumn("place", place).withColumn("edge", F.coalesce(edge, F.lit(-2.0))).where(F.col("score") >= F.col("edge") - EPSILON).drop("place", "edge")


def nearest(vectors: DataFrame, trees: int = TREES, bits: int = BITS, k: int = NEAREST, candidates: int = FIRST, miss: float = MISS, every: int = EVERY) -> DataFrame:
    """(vec_id, embedding, ...) -> query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, and null ids don't; a vector's candidates are those of its own
    dimension. Rows that repeat an id and its vector count once; of an id with
    several vectors one counts (the least digest). Ties go to the smaller id. Fewer than k other rows give as many as there are; an empty table
    gives no rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    wide = vectors.schema["embedding"].dataType.elementType.simpleString() != "float"
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    valid = stored(mapped(kept, _valid(wide), "vec_id long, v binary, d1 long, d2 long"), "valid")
    again = stored(valid.groupBy("vec_id").agg(F.min(F.struct("d1", "d2")).alias("d"), F.count("*").alias("n")).where("n > 1"), "again")
    if again.limit(1).count():
        one = valid.join(small(again), "vec_id", "left").where("n is null or (d1 = d.d1 and d2 = d.d2)").select("vec_id", "v", "d1", "d2")
        valid, was = stored(one.dropDuplicates(["vec_id"]), "valid"), valid
        dropped(was)
    # one row for the vectors of a direction: its smallest id stands for it, and the k + 1 smallest can be in a result
    ids = valid.select("d1", "d2", "vec_id")
    groups = stored(ids.groupBy("d1", "d2").agg(F.min("vec_id").alias("row"), F.count("*").alias("n"), F.max(F.col("vec_id") % every == 0).alias("asks")), "groups")
    several = stored(groups.where("n > 1").select("d1", "d2", F.col("row").alias("first")), "several")
    copies = stored(ids.join(small(several), ["d1", "d2"]).select(F.col("first").alias("row"), "vec_id"), "copies")
    firsts = stored(_smallest(copies, k + 1), "firsts")
    # a copy that isn't the first of its direction is no row of the index; one that asks gets its first's answer
    named = valid.join(small(several), ["d1", "d2"], "left").where("first is null or first = vec_id")
    asking = groups.where("asks").select("row")
    unique = named.select(F.col("vec_id").alias("row"), "v", F.length("v").alias("bytes"))
    unique = stored(unique.join(small(asking.withColumn("asks", F.lit(True))), "row", "left").select("row", "v", "bytes", F.coalesce("asks", F.lit(False)).alias("asks")), "unique")
    dropped(valid)

    sizes = stored(unique.groupBy("bytes").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")), "sizes")  # a row for each dimension
    whole = F.col("n") * F.col("bytes")
    parts = F.greatest(F.ceil(whole / PART_BYTES), F.least(F.ceil(whole / SMALL_BYTES), F.lit(SPREAD))).cast("int")
    blocks = F.greatest(F.ceil(F.col("asking") * F.col("bytes") / PART_BYTES), F.lit(1)).cast("int")
    sized = unique.join(F.broadcast(sizes.select("bytes", parts.alias("parts"), blocks.alias("blocks"))), "bytes")

    def dealt(rows: DataFrame, query: bool, level: Column) -> DataFrame:
        """An index row lies in one part and meets every block of queries, a query lies in one block and meets every part."""
        every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        rows = rows.withColumn("part", every_one("parts") if query else own("parts")).withColumn("block", own("blocks") if query else every_one("blocks"))
        return rows.select("bytes", "part", "block", "row", "v", level.alias("level"), F.lit(not query).alias("index"), F.lit(query).alias("query"))

    def searched(asks: DataFrame, level: Column, name: str) -> DataFrame:
        both = dealt(sized, False, F.lit(0).cast("long")).unionByName(dealt(asks, True, level))
        met = both.groupBy("bytes", "part", "block").applyInArrow(_searcher(wide, trees, bits, k + 1, candidates), "query long, row long, score double")
        return stored(_best(met, k + 1), name)  # the query itself is among them

    asks = sized.where("asks")
    first = searched(asks, F.lit(-1).cast("long"), "first")
    bound = first.groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    bound = bound.select(F.col("query").alias("row"), F.when(F.col("n") > k, F.col("score")).otherwise(F.lit(-1.0)).alias("score"))  # too few found: the whole table
    levels = stored(mapped(bound, _leveller(trees, bits, miss), "row long, level long"), "levels")
    met = searched(asks.join(small(levels), "row"), F.col("level"), "met")
    met = stored(_best(met.unionByName(first).groupBy("query", "row").agg(F.max("score").alias("score")), k + 1), "best")
    pairs = met.select("query", "row").join(unique.select(F.col("row").alias("query"), F.col("v").alias("qv")), "query").join(unique.select("row", "v"), "row")
    scored = stored(mapped(pairs.select("query", "row", "qv", "v"), _cosines(wide), "query long, row long, score double"), "scored")
    dropped(unique, sizes, first, levels, met)

    # back from directions to ids
    of = firsts.groupBy("row").agg(F.collect_list("vec_id").alias("ids"))  # k + 1 at most
    queries = groups.where("asks and n = 1").select(F.col("row").alias("query_id"), F.col("row").alias("query")).unionByName(copies.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query")))
    options = scored.join(of, "row", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("row"))).alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    options = stored(options.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "options")
    out = queries.join(small(options), "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _leveller(trees: int, bits: int, miss: float):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(level_for(b.column("score").to_numpy(), trees, bits, miss), pa.int64())], names=["row", "level"])

    return run


def _smallest(copies: DataFrame, n: int) -> DataFrame:
    """The n smallest ids of each class, through parts, so that no task sorts a whole large class."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    first = copies.withColumn("part", part).withColumn("p", F.row_number().over(Window.partitionBy("row", "part").orderBy("vec_id"))).where(F.col("p") <= n)
    return first.withColumn("p", F.row_number().over(Window.partitionBy("row").orderBy("vec_id"))).where(F.col("p") <= n).select("row", "vec_id")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
