"""MinHash near-duplicate classes by a multi-index Hamming join (operator 4).

1. One pass over the texts gives each document its set size, a 128-bit digest of
   its shingle set and a signature of CHUNKS * WIDTH b-bit minhashes (numpy).
2. Documents of equal sets form one class before anything is joined, so copies
   never meet each other again.
3. Multi-index: a signature is split into CHUNKS chunks of WIDTH positions. Two
   signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 positions have by
   pigeonhole a chunk with at most ERRORS differences; the allowed errors are
   enumerated by leaving out every choice of ERRORS positions, so such a pair
   always shares a key (chunk, positions kept, values). With 16 chunks of 6 and
   one error that is every pair up to distance 31 of 96; a pair of similarity
   0.75 shares a key unless all 16 chunks have two errors or more, which has a
   probability of 0.466^16 = 5e-6.
4. Keys of one class are dropped, and of keys with the same members one stays.
   In each bucket signatures are compared (FAR: a distance that similarity 0.75
   can't have, 5.5 standard deviations), and a spanning forest of the near ones
   goes on, so a bucket gives fewer rows than it has members. The forests'
   components are the groups within which all links lie.
5. Links are confirmed on the full sets inside each group, again as a spanning
   forest: a member is compared with the rest of its block only while it may
   still join something that it isn't joined to, so a dense group costs a few
   comparisons a member and a loose one all of them, and no link between two
   components is lost. Groups and buckets beyond a block's bound are split into
   blocks that meet pairwise, so no task holds more than two blocks.
6. Components by large-star/small-star on stored tables.
"""

from __future__ import annotations

from itertools import combinations
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .components import components
from .runtime import dropped, mapped, small, stored, table, tidy

CHUNKS, WIDTH, ERRORS, BITS = 16, 6, 1, 16
HASHES = CHUNKS * WIDTH
PERCENT = 75
#: Mean and 5.5 standard deviations of the distance at the least similarity.
FAR = int(HASHES * (1 - PERCENT / 100) + 5.5 * sqrt(HASHES * PERCENT / 100 * (1 - PERCENT / 100)))
#: Members of a bucket, and members and shingles of a group, that one task holds at once (two blocks at most).
BUCKET, ROWS, SHINGLES = 4096, 2000, 400_000
_BLOCK = 4096
_U = textkit.U64
_rng = np.random.default_rng(51)
_A = _rng.integers(1, 1 << 62, HASHES, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_B = _rng.integers(1, 1 << 62, HASHES, dtype=np.int64).astype(_U)
_KEPT = [list(c) for c in combinations(range(WIDTH), WIDTH - ERRORS)]
_SALT = textkit.mix(np.arange(1, CHUNKS * len(_KEPT) + 1, dtype=_U))


def signature(shingles: np.ndarray) -> np.ndarray:
    """BITS-bit minhashes of a shingle set (uint16)."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=_U)
    for at in range(0, len(shingles), _BLOCK):
        np.minimum(least, (shingles[at : at + _BLOCK, None] * _A + _B).min(axis=0), out=least)
    return (textkit.mix(least) >> _U(64 - BITS)).astype(np.uint16)


def keys(signatures: np.ndarray) -> np.ndarray:
    """(n, HASHES) signatures -> (n, CHUNKS * choices) keys of the index."""
    parts = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(_U)
    out = np.zeros((len(signatures), CHUNKS, len(_KEPT)), dtype=_U)
    for k, kept in enumerate(_KEPT):
        for x in kept:
            out[:, :, k] = textkit.mix(out[:, :, k] * _U(0x9E3779B97F4A7C15) + parts[:, :, x] + _U(1))
    return textkit.mix(out.reshape(len(signatures), -1) + _SALT)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return textkit.shingles(*textkit.words(batch.column("text")))


def _sign(batches):
    for whole in batches:
        for b in textkit.slices(whole, "text"):
            sets = _sets(b)
            digests = np.array([(textkit.mix(s).sum(dtype=_U), textkit.mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)) for s in sets], dtype=_U).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def _index(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            k = keys(_matrix(b.column("sig"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(np.repeat(b.column("id").to_numpy(), k.shape[1]))], names=["key", "id"])


def _tally(batches):
    """Buckets of every 2000 rows, counted before they are shuffled: key, least id, and for two members or more their count and a checksum."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            k = keys(_matrix(b.column("sig")))
            ids = np.repeat(b.column("id").to_numpy(), k.shape[1])
            k = k.ravel().view(np.int64)
            order = np.argsort(k, kind="stable")
            k, ids = k[order], ids[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            n = np.diff(np.append(first, len(k)))
            one = n == 1
            check = np.bitwise_xor.reduceat(textkit.mix(ids.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1)), first).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(np.minimum.reduceat(ids, first)), pa.array(n, mask=one), pa.array(check, mask=one)], names=["key", "lo", "c", "x"])


def _full(batches):
    for whole in batches:
        for b in textkit.slices(whole, "text"):
            sets = _sets(b)
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("blocks"), b.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["g", "blocks", "id", "shingles"])


def grouped(batches, keys: list[str]):
    """Rows that are sorted by their keys -> a table for each key; only the group at hand is held."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1])
    if rest is not None:
        yield rest


def forest(labels: np.ndarray, reach) -> list[tuple[int, int]]:
    """Edges that join what links join. labels: what is joined already; reach(i): the rows linked with row i.

    Row by row, of the smaller components first, until any two rows that weren't
    compared are joined anyway.
    """
    labels, passed, edges = labels.copy(), np.zeros(len(labels), dtype=bool), []
    while True:
        left = np.flatnonzero(~passed)
        names, counts = np.unique(labels[left], return_counts=True)
        if len(names) < 2:
            return edges
        i = int(left[labels[left] != names[counts.argmax()]][0])
        passed[i] = True
        near = reach(i)
        old, first = np.unique(labels[near], return_index=True)
        for name, k in zip(old.tolist(), first.tolist(), strict=True):
            if name != labels[i]:
                edges.append((i, int(near[k])))
                labels[labels == name] = labels[i]


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    e = np.concatenate([*found, np.zeros((0, 2), dtype=np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])


def _buckets(batches):
    """Members of each bucket with their signatures -> a forest of the near ones."""
    found, n = [], 0
    for t in grouped(batches, ["key", "i", "j"]):
        ids, s = t.column("id").to_numpy(), _matrix(t.column("sig"))
        if t.num_rows == 2:
            e = [(0, 1)] if (s[0] != s[1]).sum() <= FAR else []
        else:
            e = forest(np.arange(len(ids)), lambda i, s=s: np.flatnonzero((s != s[i]).sum(axis=1) <= FAR))
        if e:
            found.append(ids[np.array(e)])
            n += len(e)
        if n > 50_000:
            yield _edges(found)
            found, n = [], 0
    yield _edges(found)


def _groups(batches):
    """Members of each block (or pair of blocks) of a group with their sets -> a forest of the links."""
    found, n = [], 0
    for t in grouped(batches, ["g", "i", "j"]):
        ids, sets = t.column("id").to_numpy(), [np.frombuffer(x, dtype=_U) for x in t.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        at = np.concatenate(([0], np.cumsum(size)))
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(names), dtype=np.int64)

        def reach(i, at=at, flat=flat, mark=mark, size=size):
            own = flat[at[i] : at[i + 1]]
            mark[own] = 1
            shared = np.add.reduceat(mark[flat], at[:-1])
            mark[own] = 0
            return np.flatnonzero(100 * shared >= PERCENT * (size + size[i] - shared))

        if e := forest(t.column("label").to_numpy(), reach):
            found.append(ids[np.array(e)])
            n += len(e)
        if n > 50_000:
            yield _edges(found)
            found, n = [], 0
    yield _edges(found)


def _block_pairs(own, blocks):
    """A row of block `own` goes to each pair of blocks that it is in: (i, j), i <= j; alone in one block to (0, 0)."""
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    return F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(others)


def _streamed(rows: DataFrame, keys: list[str], run) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "a long, b long")


def _within(sets: DataFrame, labels: DataFrame, pairs: bool) -> DataFrame:
    """Links inside each block, or with `pairs` between the blocks of the groups that have several."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    at = F.explode(F.filter(_block_pairs(own, F.col("blocks")), lambda x: (x["i"] == x["j"]) != pairs))
    rows = (sets.where("blocks > 1") if pairs else sets).select("g", "id", "shingles", at.alias("at"))
    rows = rows.join(small(labels), "id", "left").select("g", "at.i", "at.j", "id", F.coalesce("label", "id").alias("label"), "shingles")
    return _streamed(rows, ["g", "i", "j"], _groups)


def _sought(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The answer, and the stored tables that it reads."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(mapped(docs, _sign, "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "signed")
    real = signed.where("doc_id is not null and n_shingles > 0")
    classes = stored(real.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes")

    signatures = classes.select("id", "sig")
    counts = mapped(signatures, _tally, "key long, lo long, c long, x long").repartition("key")
    buckets = counts.groupBy("key").agg(F.sum(F.coalesce("c", F.lit(1))).alias("c"), F.bit_xor(F.coalesce("x", F.xxhash64("lo"))).alias("x"), F.min("lo").alias("lo")).where("c > 1")
    buckets = stored(buckets.groupBy("c", "x", "lo").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / BUCKET).cast("int").alias("blocks")), "buckets")
    members = stored(mapped(signatures, _index, "key long, id long").join(small(buckets), "key"), "members")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = members.select("id", "key", F.explode(_block_pairs(own, F.col("blocks"))).alias("at")).join(signatures, "id").select("key", "at.i", "at.j", "id", "sig")
    near = stored(_streamed(rows, ["key", "i", "j"], _buckets), "near")

    # rows that repeat an id with another set hold their classes together
    digest = F.struct("n_shingles", "d1", "d2")
    again = stored(real.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id"), "again")
    twice = real.select("doc_id", "n_shingles", "d1", "d2").join(small(again), "doc_id", "left_semi").distinct().join(classes.select("n_shingles", "d1", "d2", "id"), ["n_shingles", "d1", "d2"])
    links = stored(twice.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b"), "links")
    joined = components(near.unionByName(links))
    sizes = joined.join(classes.select("id", "n_shingles"), "id").groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = stored(sizes.select("label", F.ceil(F.greatest(F.col("n") / ROWS, F.col("s") / SHINGLES)).cast("int").alias("blocks")), "sizes")
    groups = stored(joined.join(small(sizes), "label").select("id", F.col("label").alias("g"), "blocks"), "groups")
    texts = docs.withColumnRenamed("doc_id", "id").join(small(groups), "id")
    sets = stored(mapped(texts.select("g", "blocks", "id", "text"), _full, "g long, blocks int, id long, shingles binary"), "sets")
    inside = stored(_within(sets, links.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0), False), "inside").unionByName(links)
    labels = components(inside)
    if groups.where("blocks > 1").limit(1).count():
        between = stored(_within(sets, labels, True), "between")
        labels = components(inside.unionByName(between))

    # empty sets and sets of one unlinked document say nothing, so neither they nor the empty texts take part in the join
    of = classes.select("n_shingles", "d1", "d2", "id", "copies").join(labels, "id", "left").where("label is not null or copies > 1")
    of = stored(of.select("n_shingles", "d1", "d2", F.coalesce("label", "id").alias("component")), "of")
    dropped(buckets, members, near, again, links, joined, sizes, groups, sets, inside, labels, classes)
    every = signed.select("doc_id", "n_shingles", "d1", "d2")
    out = every.where("n_shingles > 0").join(small(of), ["n_shingles", "d1", "d2"], "left").select("doc_id", "n_shingles", "component")
    out = out.unionByName(every.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), [signed, of]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), a row for each row given.

    Null and blank texts have an empty set, linked with nothing. Fewer than five
    words make one shingle of the whole sequence. Rows that repeat a doc_id are
    one document: their links are on the id. A null doc_id is no document: its
    row has a null component and is kept. Other columns are not read. An empty
    table gives no rows. Joins on a text's digest and on an id are of stored
    tables, broadcast while counted as small and else split by AQE where a text
    holds many rows.
    """
    return _sought(docs)[0]


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows, all columns as they are, of one document (the smallest id) of each group; rows that repeat an id leave one, rows without an id stay."""
    found, read = _sought(docs)
    found = stored(found, "found")
    dropped(*read)
    gone = stored(found.where("not kept").select("doc_id").distinct(), "gone")
    twice = stored(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    dropped(found)
    left = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    if not twice.limit(1).count():
        return left
    again = left.join(small(twice), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return left.join(small(twice), "doc_id", "left_anti").select(*docs.columns).unionByName(again)


def op4_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Links by counting shared shingles, and the smallest id reachable by walking along them.
ORACLE = """WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t),
one AS (SELECT list_sort(s) AS s, min(doc_id) AS id, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
each AS (SELECT id, n, unnest(s) AS x FROM one),
links AS (SELECT a.id AS a, b.id AS b FROM each a JOIN each b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
walk(id, seen) AS (SELECT id, id FROM one UNION SELECT walk.id, links.b FROM walk JOIN links ON links.a = walk.seen),
least AS (SELECT id, min(seen) AS component FROM walk GROUP BY id)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN one ON one.s = list_sort(sets.s) LEFT JOIN least ON least.id = one.id"""
