"""Every operator on texts of a megabyte, ties and repeated rows, an empty table and clashing names; and every stage of the pipeline."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, quality, secrets, suffix_dedup, token_count, word_dedup
from tidemark.llm.queries import TOKENIZER

from .conftest import prose
from .test_operators import brute_hits, brute_suffixes, brute_words, got, tokenizer  # noqa: F401

ITEM = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"


def long_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(21)
    body = prose(rng, 120_000)
    return [(1, f"{body} {ITEM} password=abcdef12"), (2, f"{body[:-4000]} other end"), (3, "w " * 500_000), (3, "w " * 500_000), (4, "漢" * 300_000), (5, ""), (None, None)]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame(long_rows(), "doc_id long, text string").repartition(2)


def test_long_texts(spark, long_docs):
    rows = long_rows()
    assert all(len(t.encode()) > 700_000 for i, t in rows[:4])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    found = got(decontaminate.report(long_docs, bench), "doc_id", "n_words", "n_hit")
    assert found == sorted(((i, *brute_hits(t, [(1, ITEM)])[:2]) for i, t in rows), key=repr)
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    assert quality.scores(long_docs, labels).count() == len(rows)
    assert got(word_dedup.report(long_docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    classes = {r["doc_id"]: r["component_id"] for r in jaccard_join.report(long_docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, None: None}
    assert {r["doc_id"]: r["n_assign"] for r in secrets.report(long_docs).collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, None: 0}


def test_long_texts_of_bytes_and_tokens(spark, long_docs, tokenizer):
    rows = long_rows()
    some = [(1, rows[0][1][:400_000]), (2, rows[1][1][:300_000]), (3, "w " * 2000), (3, "w " * 2000)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert got(suffix_dedup.report(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffixes(some)
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(long_docs, TOKENIZER).collect()} == want
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(long_docs, TOKENIZER).collect()} == want


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels and a benchmark for the stages."""
    folder = str(tmp_path_factory.mktemp("stages"))
    rng = random.Random(3)
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)] + [(81, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    texts = [(i, prose(rng, 40) + "." if i < 60 else "| #### !!!! " * 9) for i in range(80)]
    texts += [(90, texts[0][1]), (90, texts[0][1]), (91, f"{prose(rng, 200)} {ITEM} {prose(rng, 40)}"), (92, ITEM), (93, f"{prose(rng, 30)} token = 'abc12345'"), (94, None), (95, ""), (None, prose(rng, 20))]
    names = {"rid": "a", "RID_": "b", "spans": "c", "hit_spans": "d", "sid": "e", "score": "f", "__rid": "g", "__spans": "h"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names.values()) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder, names


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edges(spark, tables, name):
    folder, names = tables
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    before, after = docs.collect(), out.collect()
    assert stage(spark, docs.where("false"), folder).count() == 0
    if name == "bpe_encoding":
        assert sorted((r["doc_id"] for r in after), key=repr) == sorted((r["doc_id"] for r in before), key=repr)
        return
    assert out.columns == docs.columns
    assert all(r[n] == v for r in after for n, v in names.items())
    ids = [r["doc_id"] for r in after]
    text = {r["doc_id"]: r["text"] for r in after}
    if name == "quality_classifier":
        assert {90, 91} < set(ids) and ids.count(90) == 2 and not {60, 65, 79} & set(ids)
    if name == "jaccard_dedup":
        # One of each group stays; texts without words all do.
        assert 90 not in ids and {0, 94, 95, None} < set(ids) and sum(60 <= (i or 0) < 80 for i in ids) == 1
    if name == "benchmark_decontamination":
        assert 92 not in ids and "q5" not in text[91] and len(ids) == len(before) - 1 and ids.count(90) == 2
    if name == "secret_redaction":
        assert text[93].endswith("[SECRET]'") and len(ids) == len(before) and text[94] is None
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in after)


def test_run_over_edges(spark, tables):
    folder, _ = tables
    out = corpus_pipeline.run(spark, folder)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert ids.count(90) == 0 and 0 in ids and 92 not in ids and not {61, 79} & set(ids)


def test_clashing_names_in_either_case(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", "y", "z"), (2, "a b c d e f", "x", "y", "z")], "doc_id long, text string, Rid string, RID_ string, __rid string")
    assert [tuple(r) for r in jaccard_join.one_of_each(df).collect()] == [(1, "a b c d e f", "x", "y", "z")]
    many = decontaminate.cleaned(df, spark.createDataFrame([(k, f"z{k} " * 12) for k in range(9)], "item_id long, text string"), share_bytes=40)
    assert many.columns == df.columns and many.where(F.col("Rid") == "x").count() == 2
