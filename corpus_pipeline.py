"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Order: toxic documents go, one document of each near-duplicate group stays,
documents that hold a benchmark item go, personal data is masked, and what is
left is encoded. Every stage but the last returns the columns of documents.

Every stage reads whole texts, however long, and takes all that the one before
it kept. Columns that it doesn't read pass through as they are, whatever their
names. A null or empty text is no toxic, copied or leaked text and has no
personal data and no tokens, so its row goes through to the end; so does a row
without doc_id, but for toxicity. Rows that repeat a doc_id are one document to
the near-duplicate stage, which leaves one of them. An empty table gives no rows.

Before a stage the executors give back the heap that the stages before it grew,
so that a stage needs the memory of its own operator only.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from hopweave.llm import decontaminate, near_dup, pii, sentencepiece_codec, toxicity
from hopweave.llm.runtime import relieved, stored, table


def _stage(run):
    """A stage that begins with memory given back."""

    @wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        relieved(spark)
        return run(spark, docs, sf_dir)

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: rows whose calibrated noisy-or score is 0.7 or more go; trained on the labelled documents at hand. Where those are of one class, every row has the score of their share."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the smallest id of each group stays; rows without an id stay."""
    return near_dup.one_of_each(docs)


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that contain an item of `benchmark` go; items without id or text are in none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every span found is written as its kind; n_chars follows the new text, and a null text stays null."""
    return pii.mask(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: doc_id, n_tokens, ids, round_trip; no tokens for a null or empty text."""
    return sentencepiece_codec.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("sentencepiece", encode),
]

#: SQL can express neither the trained models nor the encoder; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
