"""Token counts as delta-maintained rollups (operator 10).

A batch is a table of signed changes: inserts (+), deletes (-) and revisions
(the old count back, the new one in). It is summed up by source, language and
tokenizer version before it is written, so a batch costs one row for each
group, however many documents it holds, and a group's total is the sum over all
committed batches.

A batch is committed once: its delta is written to a folder of its own and
becomes visible by one rename to `batch=<id>`. A batch whose folder is there is
left out, so a batch that is sent again after a lost driver changes nothing;
what an unfinished try left behind is never read. `compact` folds the batches
of one listing into a base that names them; the base counts from one rename on,
in place of what it names, and a batch that is committed meanwhile is in neither
the sums nor the names. Folders that a base has folded are then deleted.

Tokens are counted by the tokenizers of TOKENIZERS on whole texts: white-space
words in Spark's own functions, and a byte-level BPE by tiktoken in Arrow
batches.
"""

from __future__ import annotations

import base64
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .runtime import dropped, mapped, new_path, stored, table

#: The vocabulary's path is a parameter; the driver reads it and its bytes go to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORDS, BPE = "words-1", "byte_bpe_50k-1"
GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

# The split pattern of the byte-level BPE vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest stretch handed to the tokenizer at once; cut before a space that follows a letter, where no token crosses.
PIECE = 200_000


def pieces(text: str, most: int = PIECE) -> list[str]:
    """A long text in parts that are tokenized alike: each cut is before a single space between two letters."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while cut >= 0 and not (text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def encoding(raw: bytes):
    """The tokenizer of a vocabulary file's bytes."""
    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(raw: bytes):
    def run(batches):
        e = encoding(raw)  # a task's own, gone with it
        for whole in batches:
            for b in textkit.slices(whole, "text"):
                n = [sum(len(e.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c for c, f in zip(b.columns, b.schema.names, strict=True) if f != "text"), pa.array(n, pa.int64())], names=[*(f for f in b.schema.names if f != "text"), "bpe"])

    return run


def words(text: Column) -> Column:
    """White-space words of a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, source, lang, ...) -> doc_id, source, lang, tokenizer, n_tokens, n_chars: a row for each document and tokenizer.

    Null texts count as empty, a null source or language as ''. Rows that repeat
    count each, and so do rows with a null doc_id; an empty table gives no rows.
    Very long texts are counted whole. Other columns aren't read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.length(text).cast("long").alias("n_chars"), words(text).alias("words"), text.alias("text"))
    both = mapped(rows, _counter(Path(vocabulary).read_bytes()), "doc_id long, source string, lang string, n_chars long, words long, bpe long")
    each = F.explode(F.array(F.struct(F.lit(WORDS).alias("tokenizer"), F.col("words").alias("n_tokens")), F.struct(F.lit(BPE).alias("tokenizer"), F.col("bpe").alias("n_tokens")))).alias("e")
    return both.select("doc_id", "source", "lang", "n_chars", each).select("doc_id", "source", "lang", "e.tokenizer", "e.n_tokens", "n_chars")


def inserts(rows: DataFrame) -> DataFrame:
    """Counted rows as changes that add them."""
    return rows.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_chars")


def deletes(rows: DataFrame) -> DataFrame:
    """Counted rows as changes that take them away."""
    return rows.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_chars")).alias("n_chars"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old rows back and the new ones in; groups may differ."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals kept as committed deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jpath(f"{self.path}/{name}")

    def _listed(self) -> tuple[str | None, list[str], dict[str, str]]:
        """Of one listing: the last base, the batches folded into it, and the folders of those that aren't."""
        if not self._fs.exists(self._jpath(self.path)):
            return None, [], {}
        found = {s.getPath().getName(): s.getPath().toString() for s in self._fs.listStatus(self._jpath(self.path))}
        last = max((int(n[5:]) for n in found if n.startswith("base=")), default=None)
        base = None if last is None else found[f"base={last}"]
        folded = [r["value"] for r in self.spark.read.text(base + "/folded").collect()] if base else []  # one id for each folded batch
        gone = {f"batch={b}" for b in folded}
        return base, folded, {n[6:]: at for n, at in found.items() if n.startswith("batch=") and n not in gone}

    def batches(self) -> list[str]:
        """Ids of the batches that count: committed ones, those folded into a base by its list."""
        _, folded, open_ = self._listed()
        return sorted({*folded, *open_})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False, and nothing done, if it is there already."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.batches():
            return False
        trying = f".try-{batch}-{uuid.uuid4().hex}"
        _summed(changes).write.parquet(f"{self.path}/{trying}")
        if self._fs.exists(self._at(f"batch={batch}")) or not self._fs.rename(self._at(trying), self._at(f"batch={batch}")):
            self._fs.delete(self._at(trying), True)
            return False
        stray = self._at(f"batch={batch}/{trying}")  # some stores move into a folder that came meanwhile
        if self._fs.exists(stray):
            self._fs.delete(stray, True)
            return False
        return True

    def _deltas(self, base: str | None, folders: dict[str, str]) -> DataFrame:
        paths = [*folders.values(), *([base + "/sums"] if base else [])]
        return self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)

    def deltas(self) -> DataFrame:
        base, _, folders = self._listed()
        return self._deltas(base, folders)

    def totals(self) -> DataFrame:
        """Sums by source, language and tokenizer over all that is committed; groups that came down to nothing are left out."""
        return _summed(self.deltas())

    def compact(self) -> None:
        """Fold what one listing shows into a new base; its one rename makes it count in place of the batches it lists.

        Folded folders are deleted after the rename. A reader that listed them
        before and reads them after fails on a missing file and may read again.
        """
        old, folded, folders = self._listed()
        if not folders:
            return
        number = int(old.rpartition("=")[2]) + 1 if old else 1
        trying = f".try-base-{uuid.uuid4().hex}"
        _summed(self._deltas(old, folders)).write.parquet(f"{self.path}/{trying}/sums")
        self.spark.createDataFrame([(n,) for n in sorted({*folded, *folders})], "value string").coalesce(1).write.text(f"{self.path}/{trying}/folded")
        if self._fs.exists(self._at(f"base={number}")) or not self._fs.rename(self._at(trying), self._at(f"base={number}")) or self._fs.exists(self._at(f"base={number}/{trying}")):
            self._fs.delete(self._at(f"base={number}/{trying}"), True)
            self._fs.delete(self._at(trying), True)
            raise RuntimeError(f"base {number} was made by another writer")
        for at in [*folders.values(), *([old] if old else [])]:
            self._fs.delete(self._jpath(at), True)


def _summed(changes: DataFrame) -> DataFrame:
    sums = changes.groupBy(*GROUP).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])
    return sums.where(" or ".join(f"{m} <> 0" for m in MEASURES))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after a life of batches: inserted with a guess (a token for four characters), revised by the counts, the first batch sent twice, folded; rows without a text deleted and put back.

    Every row of `documents` counts once in the result, whatever its text. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    exact = stored(counted(docs), "counts")
    provisional = exact.withColumn("n_tokens", F.floor(F.col("n_chars") / 4).cast("long"))
    rollup = Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("insert-1", inserts(provisional))
    rollup.commit("revise-1", revisions(provisional, exact))
    rollup.commit("insert-1", inserts(provisional))
    rollup.compact()
    empty = exact.where("n_chars = 0")
    rollup.commit("delete-1", deletes(empty))
    rollup.commit("insert-2", inserts(empty))  # the totals cover all documents
    dropped(exact)
    return rollup.totals()
