"""Every operator on empty tables, nulls, repeats, ties, very long texts, int ids and clashing columns; queries on whole tables against plain re-statements."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.llm import decontaminate, hash_forest, html_text, near_dup, pii, quotes, secrets, spans, token_counts, toxicity
from hopweave.llm import sentencepiece_codec as sc
from hopweave.llm.runtime import new_path, table

from .test_kernels import plain_pii, plain_secrets, split

LONG = "the rain in Spain 12 " * 62_000 + "mail a@b.co"  # 1.3 MB
TEXTS = [LONG, "", None, " \n\t ", "same text in many rows of the table", "same text in many rows of the table", "x" * 3000, "é😀 ß\x00z", "> quoted\n>> deeper"]
CLASH = ("spans", "row", "score", "h", "d1", "key", "label", "id", "x", "n", "sig", "own", "bpe", "words", "level", "position", "component")
DOCS = "doc_id int, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 2 else "en", "s", 1, *["clash"] * len(CLASH)) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id at all", None, None, None, *[None] * len(CLASH))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def model():
    return toxicity.Model(np.zeros(1 << toxicity.FEATURE_BITS, dtype=np.float32), -3.0)


def by_row(name, model):
    return {
        "pii": pii.pii_spans, "mask": pii.mask, "secrets": secrets.secret_spans, "near": near_dup.near_duplicates, "toxicity": lambda d: toxicity.scores(d, model),
        "clean": lambda d: toxicity.clean(d, model), "sentencepiece": sc.encoded, "digests": lambda d: sc.encoded(d, digests=True), "counts": lambda d: token_counts.counted(d).where(F.col("tokenizer") == token_counts.WORDS),
    }[name]


@pytest.mark.parametrize("name", ["pii", "mask", "secrets", "near", "toxicity", "clean", "sentencepiece", "digests", "counts"])
def test_a_row_for_each_row(odd, model, name):
    run = by_row(name, model)
    got = run(odd).collect()
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == [-1, *sorted([*range(len(TEXTS)), 4, 4])]
    assert run(odd.limit(0)).count() == 0


def test_long_texts_whole(odd, model):
    first = lambda d: d.where("doc_id = 0").first()
    assert first(pii.pii_spans(odd))["n_email"] == 1 and first(pii.mask(odd))["text"].endswith("mail [EMAIL]")
    row = first(sc.encoded(odd, digests=True))
    assert row["round_trip"] and row["ids_sha256"] == _library(LONG)
    assert first(token_counts.counted(odd).where(F.col("tokenizer") == token_counts.WORDS))["n_tokens"] == len(LONG.split())
    assert first(near_dup.near_duplicates(odd))["n_shingles"] == len(split(LONG)[1])
    bpe = first(token_counts.counted(odd).where(F.col("tokenizer") == token_counts.BPE))["n_tokens"]
    from pathlib import Path

    assert bpe == len(token_counts.encoding(Path(token_counts.VOCABULARY).read_bytes()).encode_ordinary(LONG))
    items = odd.sparkSession.createDataFrame([(1, "in Spain 12 the rain in Spain mail a@b.co"), (2, "Spain 12 mail a@b.co"), (None, "x"), (3, "the rain in Spain 12 the")], "item_id int, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(odd, items).collect()} == {(0, 3)}


def _library(text: str) -> str:
    import sentencepiece

    return hashlib.sha256(np.array(sentencepiece.SentencePieceProcessor(model_file=sc.MODEL).encode(text or ""), dtype="<i4").tobytes()).hexdigest()


def test_ids_are_the_librarys_on_a_whole_table(spark, sf_dir):
    want = {r["doc_id"]: _library(r["text"]) for r in table(spark, sf_dir, "documents").collect()}
    got = sc.op8_sentencepiece(spark, sf_dir).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == want and all(r["round_trip"] for r in got)


def test_window_is_bounded():
    codec = sc.Codec(sc.load())
    text = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(1_200_000))
    assert "".join(codec.stream(text[i : i + 512] for i in range(0, len(text), 512))) == text
    assert codec.widest <= 8 * codec.longest


def test_learned_stretches_are_the_streamed_ones():
    v = sc.load()
    one, other = sc.Codec(v), sc.Codec(v)
    texts = ["the rain in Spain falls mainly", "therein theremin there, then\n\nthe  end ", "", "é日 aaaa aaaab aaab"] * 2
    assert [x.tolist() for x in one.encode_all(texts)] == [other.encode(t).tolist() for t in texts]


def test_a_word_is_in_one_table():
    v = sc.load()
    codec, other = sc.Codec(v), sc.Codec(v)
    texts = ["the rain in Spain falls mainly", "the  rain\n\nmainly  therein", "therein, Spain"]
    assert [[x.tolist() for x in codec.encode_all([t])] for t in texts] == [[other.encode(t).tolist()] for t in texts]
    assert {"the", "rain", "Spain"} <= codec.plain.keys() and not {sc.MARK + w for w in texts[0].split()} & codec.memory.keys()


@pytest.mark.parametrize(("query", "plain", "kinds", "module"), [(pii.op1_pii, plain_pii, pii.BASE, pii), (secrets.op3_secrets, plain_secrets, secrets.BASE, secrets)])
def test_base_spans_on_a_whole_table(spark, sf_dir, query, plain, kinds, module):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = query(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in own) for k in kinds]
        assert r["base_sha256"] == spans.digest(own) and set(filter(None, spans.joined(own).split(","))) <= set(r["spans"].split(","))


def test_nearest_recall_on_a_whole_table(spark, sf_dir):
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table(spark, sf_dir, "embeddings").collect() if r["embedding"] and None not in r["embedding"]}
    x = {i: v / np.linalg.norm(v) for i, v in x.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(list(x))
    every = np.stack(list(x.values()))
    got = hash_forest.op5_nearest(spark, sf_dir).collect()
    hits = total = 0
    for q in (i for i in x if i % 50 == 0):
        s = every @ x[q]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hits += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
        total += 5
    assert hits >= 0.9 * total


def test_rollup_while_it_is_folded(spark):
    """A batch that is committed between a fold's listing and its rename counts once."""
    roll = token_counts.Rollup(spark, new_path(spark, "test"))
    batch = lambda n: spark.createDataFrame([("s", "en", "t", 1, n, 1)], token_counts._DELTA)
    roll.commit("a", batch(10))
    deltas = roll._deltas

    def late(*given):
        roll._deltas = deltas
        assert roll.commit("b", batch(5))
        return deltas(*given)

    roll._deltas = late
    roll.compact()
    assert [(r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()] == [(2, 15)] and roll.batches() == ["a", "b"]
    roll.compact()
    assert [(r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()] == [(2, 15)] and not roll.commit("a", batch(1))
    names = [s.getPath().getName() for s in roll._fs.listStatus(roll._jpath(roll.path))]
    assert names == ["base=2"]


def test_rollup_on_a_whole_table(spark, sf_dir):
    from pathlib import Path

    e, want = token_counts.encoding(Path(token_counts.VOCABULARY).read_bytes()), {}
    for r in table(spark, sf_dir, "documents").collect():
        text = r["text"] or ""
        for name, n in ((token_counts.WORDS, len([w for w in split(text)[0]])), (token_counts.BPE, len(e.encode_ordinary(text)))):
            k = (r["source"] or "", r["lang"] or "", name)
            want[k] = tuple(a + b for a, b in zip(want.get(k, (0, 0, 0)), (1, n, len(text)), strict=True))
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"], r["n_chars"]) for r in token_counts.op10_token_rollup(spark, sf_dir).collect()} == want


def test_pages_and_messages(spark):
    page = "<article><p>" + "The story of the day is long and it has many of the words. " * 25_000 + "</p></article>"
    pages = spark.createDataFrame([(1, "u", page, "c", 1), (1, "u", page, "c", 1), (None, None, None, None, None)], "page_id int, url string, html string, text string, n_chars int")
    got = html_text.extracted(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 25_000 * 59 - 1, 25_000 * 59 - 1] and html_text.extracted(pages.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, 0, "u", LONG, 9), (1, 1, "a", "> " + LONG[:1_000_000] + "\nok", 9), (1, 1, "a", None, 9), (None, 3, None, "> x", 9), (2, None, "u", "y", 9)], "conv_id int, turn int, role string, text string, level int")
    got = quotes.conversations(rows).collect()
    assert len(got) == 5 and sorted(r["text"] or "" for r in got)[0] == "" and quotes.conversations(rows.limit(0)).count() == 0


def test_first_of_equal_sentences(model):
    import pyarrow as pa

    _, n, _, begin, end = toxicity._weigher(model)(pa.array(["é. é. é.", ""]))
    assert n.tolist() == [3, 1] and begin.tolist() == [0, 0] and end.tolist() == [2, 0]


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Nulls, repeats, long texts and clashing columns go through all stages; an empty table gives no rows."""
    import corpus_pipeline

    odd.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    odd.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for d in ("full", "none"):
        spark.createDataFrame([(4, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / d / "labels.parquet"))
        spark.createDataFrame([(1, "no id at all"), (2, None), (3, "x" * 3000)], "item_id long, text string").write.parquet(str(tmp_path / d / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    # repeats leave one row, 5 is a copy of 4, 6 holds an item, the row without an id stays
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == [-1, 0, 1, 2, 3, 4, 7, 8] and all(r["round_trip"] for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
