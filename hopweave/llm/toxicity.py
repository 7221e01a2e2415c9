"""Toxicity by multiple-instance learning (operator 6).

A document is a bag of sentences. A sentence's probability is logistic in hashed
words and word beginnings; the document's is the noisy-or 1 - prod(1 - p). Only
documents carry labels: the noisy-or likelihood passes the blame on to the
sentences that explain it, so the model can point at them afterwards.

Training uses a bounded sample of labelled rows (SAMPLE documents and
SAMPLE_BYTES of features, taken in the order of a hash of the id); features are
cut out on the executors and only they come to the driver. A noisy-or fitted so
is too timid on documents it hasn't seen, so its log-odds are put on the scale
of observed shares: two models, each of one half of the sample, score the other
half, and a logistic line through those scores is what the final score goes
through. Scoring is one pass over all whole texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .runtime import dropped, mapped, stored, table

#: Most labelled documents that training reads, and most bytes of their features.
SAMPLE, SAMPLE_BYTES = 8_000, 96 << 20
#: Least rows of either class for which scores are calibrated.
CALIBRATED = 20
FEATURE_BITS = 20
#: Lengths in bytes of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6, 7)
MIN_DOCUMENTS = 6
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 200, 0.1, 1e-4
_PART = 250

_U = textkit.U64
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 63]] = True  # line feed ! . ?
_CODE = textkit._BYTE_CODE[textkit._LOWER]
_PREFIX_SALT = textkit.mix(np.arange(1, len(PREFIXES) + 1, dtype=_U))


@dataclass
class Model:
    weights: np.ndarray  # one for each hashed feature
    bias: float
    slope: float = 1.0  # of the document's log-odds, and what is added to them
    shift: float = 0.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as hashed features (n, 1 + prefixes; -1: none), each word's sentence, each row's first sentence, and the sentences' byte ranges.

    A sentence ends with . ! ? or a line feed; one without letters has no words.
    Every row has a sentence at least, so an empty text gets the bias alone.
    """
    data, at = textkit.buffers(column)
    n = len(data)
    letter = _LETTER[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:n]
    end[:-1] &= ~letter[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(_CODE[data] * textkit._power(textkit._BASE, n, "up"), out=total[1:])
    down = textkit._power(textkit._INVERSE, max(n, 1), "down")[starts] if n else np.zeros(0, dtype=_U)
    shift = _U(64 - FEATURE_BITS)
    out = np.full((len(starts), 1 + len(PREFIXES)), -1, dtype=np.int32)
    out[:, 0] = (textkit.mix((total[ends] - total[starts]) * down) >> shift).astype(np.int32)
    for k, size in enumerate(PREFIXES):
        long = ends - starts > size
        x = textkit.mix((total[starts[long] + size] - total[starts[long]]) * down[long] + _PREFIX_SALT[k])
        out[long, 1 + k] = (x >> shift).astype(np.int32)
    # sentences: cuts after a stop, and at each row's begin
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:] = _STOP[data]
    cut[at] = True
    first = np.flatnonzero(cut[:n])
    first = np.sort(np.concatenate((first, at[:-1][at[:-1] == at[1:]])))  # empty rows
    row_first = np.searchsorted(first, at[:-1], side="left")
    for i in np.flatnonzero(at[:-1] == at[1:]):  # an empty row's sentence stands before the next row's
        row_first[i] = np.searchsorted(first, at[i], side="left") + np.count_nonzero(at[:-1][:i] == at[i])
    filled = np.flatnonzero(at[:-1] < at[1:])
    row_first[filled] = np.searchsorted(first, at[filled], side="right") - 1
    stop = np.append(first[1:], n)
    sentence = np.searchsorted(first, starts, side="right") - 1
    return out, sentence, row_first, first, stop


def _cut(batches):
    for whole in batches:
        for b in textkit.slices(whole, "text"):
            x, sentence, row_first, first, _ = features(b.column("text"))
            bounds = np.append(row_first, len(first))
            w = np.searchsorted(sentence, bounds)
            held, where = [], []
            for i, j, s in zip(w[:-1], w[1:], row_first, strict=True):
                pairs = ((sentence[i:j, None] - s) << FEATURE_BITS) | x[i:j]
                pairs = np.unique(pairs[x[i:j] >= 0])  # a feature counts once a sentence
                held.append((pairs & ((1 << FEATURE_BITS) - 1)).astype(np.int32).tobytes())
                where.append((pairs >> FEATURE_BITS).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in b.schema.names if k != "text"), pa.array(held, pa.binary()), pa.array(where, pa.binary()), pa.array(np.diff(bounds).astype(np.int32))], names=[*(k for k in b.schema.names if k != "text"), "x", "sentence", "n"])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list) -> Model:
    """Fit by gradient steps (Adam) on the noisy-or likelihood. Without rows of both classes the score is the share of toxic rows."""
    y = np.array([r["toxic"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 0.999))
        return Model(np.zeros(1 << FEATURE_BITS, dtype=np.float32), float(np.log(share / (1 - share))))
    used = np.zeros(1 << FEATURE_BITS, dtype=np.int32)
    for r in rows:
        used[np.unique(np.frombuffer(r["x"], dtype=np.int32))] += 1
    ids = np.flatnonzero(used >= MIN_DOCUMENTS)
    small = np.full(1 << FEATURE_BITS, -1, dtype=np.int32)
    small[ids] = np.arange(len(ids))
    parts, sentences = [], sum(r["n"] for r in rows)
    for at in range(0, len(rows), _PART):  # documents go part by part, so that a step's arrays stay small
        part = rows[at : at + _PART]
        counts = np.array([r["n"] for r in part])
        base = np.concatenate(([0], np.cumsum(counts)))
        cols, where = [], []
        for k, r in enumerate(part):
            c = small[np.frombuffer(r["x"], dtype=np.int32)]
            cols.append(c[c >= 0])
            where.append((np.frombuffer(r["sentence"], dtype=np.int32)[c >= 0] + base[k]).astype(np.int32))
        parts.append((np.concatenate(cols), np.concatenate(where), np.repeat(np.arange(len(part)), counts).astype(np.int32), y[at : at + _PART]))
    theta, m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    theta[-1] = np.log(y.mean() * len(y) / sentences)
    for t in range(1, STEPS + 1):
        g = RIDGE * np.append(theta[:-1], 0.0)
        for col, which, doc, own in parts:
            z = np.bincount(which, weights=theta[col], minlength=len(doc)) + theta[-1]
            p = np.minimum(sigmoid(z), 1 - 1e-9)
            none = np.exp(np.maximum(np.bincount(doc, weights=np.log1p(-p), minlength=len(own)), -30))
            slope = p * np.where(own[doc] > 0, -none[doc] / np.maximum(1 - none[doc], 1e-9), 1.0)
            g += np.append(np.bincount(col, weights=slope[which], minlength=len(ids)), slope.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << FEATURE_BITS, dtype=np.float32)
    weights[ids] = theta[:-1]
    return Model(weights, float(theta[-1]))


def log_odds(quiet: np.ndarray) -> np.ndarray:
    """Of a noisy-or, from the log of the chance that no sentence is toxic."""
    return np.log(np.maximum(-np.expm1(quiet), 1e-12)) - quiet


def _quiet(rows: list, model: Model) -> np.ndarray:
    out = np.zeros(len(rows))
    for k, r in enumerate(rows):
        w = model.weights[np.frombuffer(r["x"], dtype=np.int32)]
        z = np.bincount(np.frombuffer(r["sentence"], dtype=np.int32), weights=w, minlength=r["n"]) + model.bias
        out[k] = np.log1p(-np.minimum(sigmoid(z), 1 - 1e-12)).sum()
    return out


def calibrated(rows: list) -> Model:
    """The model of all rows, its log-odds on the line that fits those of two half models on the halves they haven't seen."""
    y = np.array([r["toxic"] for r in rows], dtype=float)
    model = fit(rows)
    if min(y.sum(), len(y) - y.sum()) < CALIBRATED:
        return model
    x = np.zeros(len(rows))
    for k in (0, 1):
        x[k::2] = np.clip(log_odds(_quiet(rows[k::2], fit(rows[1 - k :: 2]))), -20, 20)
    theta, ones = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):  # Newton steps, held by a light pull to the uncalibrated line
        p = sigmoid(ones @ theta)
        slope = ones.T @ (p - y) + (theta - [1.0, 0.0])
        curve = (ones * (p * (1 - p))[:, None]).T @ ones + np.eye(2)
        theta = theta - np.linalg.solve(curve, slope)
    if theta[0] > 0:
        model.slope, model.shift = float(theta[0]), float(theta[1])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 modulo 3 (a null id isn't held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    """Fit on at most `sample` labelled rows, and `most` bytes of their features, that aren't held out.

    Rows without id, label or text row take no part; of an id with several labels
    the larger counts, of one with several texts the least. No labelled row gives
    the score of a rare event.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by `sample`
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    own = own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    cut = stored(mapped(own.select("doc_id", "toxic", "text"), _cut, "doc_id long, toxic int, x binary, sentence binary, n int"), "features")
    so_far = F.sum(F.length("x") + F.length("sentence")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of `sample` rows at most
    taken = cut.select("doc_id", so_far.alias("bytes")).where(F.col("bytes") <= most)
    rows = cut.join(F.broadcast(taken.select("doc_id")), "doc_id", "left_semi").drop("doc_id").toArrow().to_pylist()  # bounded by `most`
    dropped(cut)
    return calibrated(sorted(rows, key=lambda r: (crc32(r["x"]), crc32(r["sentence"]), r["toxic"])))


def _weigher(model: Model):
    """A function of a text column: each row's score, its sentences, and its worst sentence's score and range in code points."""
    bias, kept = model.bias, np.flatnonzero(model.weights)
    values = model.weights[kept]

    def weigh(column: pa.Array, w: list = []):  # noqa: B006  the table is made once a task
        if not w:
            w.append(np.zeros((1 << FEATURE_BITS) + 1, dtype=np.float32))  # the last is of "none"
            w[0][kept] = values
        x, sentence, row_first, first, stop = features(column)
        pairs = np.unique(((sentence[:, None] << FEATURE_BITS) | x)[w[0][x] != 0])
        z = np.bincount(pairs >> FEATURE_BITS, weights=w[0][pairs & ((1 << FEATURE_BITS) - 1)], minlength=len(first)) + bias
        p = np.minimum(sigmoid(z), 1 - 1e-12)
        quiet = np.add.reduceat(np.log1p(-p), row_first)
        bounds = np.append(row_first, len(first))
        worst = np.array([i + int(np.argmax(p[i:j])) for i, j in zip(bounds[:-1], bounds[1:], strict=True)])
        data, at = textkit.buffers(column)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
        return sigmoid(model.slope * log_odds(quiet) + model.shift), np.diff(bounds), p[worst], points[first[worst]] - points[at[:-1]], points[stop[worst]] - points[at[:-1]]

    return weigh


def _scorer(model: Model):
    weigh = _weigher(model)

    def score(batches):
        for whole in batches:
            for b in textkit.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, weigh(b.column("text")))], names=["doc_id", "score", "n_sentences", "worst_score", "worst_begin", "worst_end"])

    return score


def _sieve(model: Model, threshold: float):
    weigh = _weigher(model)

    def run(batches):
        for whole in batches:
            for b in textkit.slices(whole, "text"):
                yield b.filter(pa.array(weigh(b.column("text"))[0] < threshold))

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) -> a row each: doc_id, score, n_sentences, and the worst sentence's score and range in code points.

    Null and empty texts are one empty sentence. Ties go to the first sentence.
    Repeated rows are kept as rows, a null doc_id stays null, other columns
    aren't read, an empty table gives no rows. Very long texts are scored whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, _scorer(model), "doc_id long, score double, n_sentences long, worst_score double, worst_begin long, worst_end long")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns as they are, whose score is below the threshold."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return mapped(docs, _sieve(model, threshold), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = scores(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst_score", "worst_begin", "worst_end")
