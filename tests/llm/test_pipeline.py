"""The pipeline: its stages' contract, and the whole run against plain versions of the stages on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import quality

from .test_operators import brute_components, brute_hits, plain_features, sha, tokenizer  # noqa: F401
from .test_secrets import brute_spans


def redacted(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = "", 0
    for s, _, e in brute_spans(text):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def test_stages_against_plain_versions(spark, data, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "jaccard_dedup", "benchmark_decontamination", "secret_redaction", "bpe_encoding"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_classifier"](spark, docs, data)
    assert good.columns == docs.columns
    # The model's numbers, applied by hand to features counted by loops.
    ranker = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good_ids = set()
    for r in docs.select("doc_id", "text").collect():
        z = [max(-8.0, min(8.0, (x - m) / s)) for x, m, s in zip(plain_features(r["text"]), ranker.mean, ranker.scale, strict=True)]
        if sum(a * w for a, w in zip(z, ranker.weights, strict=True)) >= ranker.threshold:
            good_ids.add(r["doc_id"])
    assert {r[0] for r in good.select("doc_id").collect()} == good_ids
    single = stage["jaccard_dedup"](spark, good, data)
    rows = [(r["doc_id"], r["text"]) for r in good.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, c in brute_components(rows) if i == c)
    clean = stage["benchmark_decontamination"](spark, single, data)
    assert clean.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, text in before.items():
        n, hit, *_ = brute_hits(text, items)
        assert (i in after) == (hit <= 50 and hit <= 0.2 * n), i
        if i in after:
            assert (after[i] == text) == (hit == 0)
            assert brute_hits(after[i], items)[0] == n - hit
    hidden = {r["doc_id"]: r["text"] for r in stage["secret_redaction"](spark, clean, data).collect()}
    assert hidden == {i: redacted(t) for i, t in after.items()}
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, data).collect()}
    assert set(last) == set(hidden)
    for i, text in hidden.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert bytes(last[i]["ids"]) == b"".join(k.to_bytes(4, "little") for k in ids) and last[i]["n_tokens"] == len(ids)
        assert last[i]["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False))
