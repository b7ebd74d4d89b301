"""Steps whose work must not grow faster than the input: how often a pattern is worked out, what is shuffled, how often a table is read."""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from tidemark.operators import actors, facts, learn
from tidemark.operators import text as T
from tidemark.plans import market, texts
from tidemark.sources import paged
from tidemark.streaming import episodes


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_grow_with_the_chain_and_tokens_are_followed_once(tmp_path, monkeypatch):
    n, asked = 300, []
    for k in range(n):
        (tmp_path / f"token=t{k}").mkdir()
        (tmp_path / f"token=t{k}" / "part-0.json").write_text(json.dumps({"records": [k], "next": f"t{k + 1}" if k < n - 1 else None}))
    page = paged.FolderPages.page
    monkeypatch.setattr(paged.FolderPages, "page", lambda self, token: (asked.append(token), page(self, token))[1])
    reader = paged.PagedStream({"path": str(tmp_path), "first": "t0", "pagesPerBatch": "2"})
    start, got, batches = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        assert len(parts) <= paged.TASKS
        got += [t for p in parts for t in p.tokens]
        start, batches = end, batches + 1
    assert got == asked == [f"t{k}" for k in range(n)]
    assert batches < 30
    # A reader that was started anew plans the same pages between the same offsets.
    again = paged.PagedStream({"path": str(tmp_path), "first": "t0", "pagesPerBatch": "2"})
    assert [t for p in again.partitions({"token": "t7", "pages": 7}, {"token": "t200", "pages": 200}) for t in p.tokens] == [f"t{k}" for k in range(7, 200)]


def test_stretches_are_not_shuffled_to_the_few_beginnings(spark):
    docs = spark.createDataFrame([(1, "the heath")], "id long, t string")
    dictionary = spark.createDataFrame([("a", "the", True, None, None)], "topic string, term string, inside boolean, context string, parent string")
    out = T.match_anywhere(docs, dictionary, "id", "t")
    assert "strategy=broadcast" in plan(out)
    assert [tuple(r) for r in out.collect()] == [(1, "a", "explicit", 1)]


def test_a_text_is_gone_through_once_for_all_terms(spark):
    docs = spark.createDataFrame([(1, "the heath \u00e9"), (2, None)], "id long, t string")
    dictionary = spark.createDataFrame([("a", "the", True, None, "b"), ("b", "\u00e9", None, "heath", None)], "topic string, term string, inside boolean, context string, parent string")
    out = T.match_anywhere(docs, dictionary, "id", "t")
    assert {tuple(r) for r in out.collect()} == {(1, "a", "explicit", 1), (1, "b", "explicit", 1)}
    # No row for a stretch or a place, one pass over the texts, and one shuffle of what was found.
    steps = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Generate" not in steps and steps.count("MapInArrow") == 1
    assert len(re.findall(r"Exchange hashpartitioning\(id#", steps)) == 1


def test_terms_of_a_trie_equal_a_plain_search(monkeypatch):
    monkeypatch.setattr(T, "STEP", 50)
    r = random.Random(3)
    made = ["".join(r.choice("ab1 \u00e9\u4e2d") for _ in range(r.choice([1, 1, 2, 3, 5, 9, 40]))) for _ in range(200)]
    rows = [None if k % 17 == 0 else "".join(r.choice([*"ab1 -\u00e9\u4e2d", *made[:5]]) for _ in range(r.choice([0, 1, 5, 60, 300]))) for k in range(150)]
    for some in (made, made[:3], ["b"], ["ab1"], []):
        terms = sorted({t.encode() for t in some})
        trie = T.Trie(terms)
        for text in (pa.array(rows, pa.string()), pa.array(rows, pa.string()).slice(7, 60), pa.array([None, ""], pa.string())):
            want = {(k, i, bool(re.search(rf"(?<![A-Za-z0-9]){re.escape(t.decode())}(?![A-Za-z0-9])", x))) for k, x in enumerate(text.to_pylist()) for i, t in enumerate(terms) if t.decode() in (x or "")}
            got = list(zip(*(x.tolist() for x in T.terms_in(text, trie)), strict=True))
            assert len(got) == len(want) and set(got) == want


def test_character_grams_in_one_pass(spark):
    df = spark.createDataFrame([("a\n😀bc",), ("ab",), ("abc",), (None,)], "t string")
    out = df.select(T.char_grams(df["t"], 3).alias("g"))
    assert [r["g"] or [] for r in out.collect()] == [["a\n😀", "\n😀b", "😀bc"], [], ["abc"], []]
    assert "substring" not in plan(out)


def test_a_text_is_taken_apart_once_by_quantities(spark):
    df = spark.createDataFrame([("1万元和2GW, 3台",)], "t string")
    out = df.select(facts.quantities("t").alias("q"))
    assert plan(out).count("regexp_extract_all(") == 1 and plan(out).count("split(") == 1
    assert [q["key"] for q in out.first()["q"]] == ["CNY:10000", "MW:2000", "台:3"]


@pytest.mark.parametrize("query, fit", [("fit_ridge", "ridge"), ("fit_logistic", "logistic_fit")])
def test_models_read_the_panel_from_a_table(spark, data, monkeypatch, query, fit):
    seen = []
    monkeypatch.setattr(learn, fit, lambda s, rows, *_: seen.append(rows))
    market.QUERIES[query](spark, data)
    assert "distinct" not in plan(seen[0]) and "get_json_object" not in plan(seen[0])


def test_phrases_are_counted_once_for_pruning(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(T, "pruned_phrases", lambda terms, factor: (seen.append(terms), terms)[1])
    texts.QUERIES["phrase_prune"](spark, data)
    assert "Aggregate" not in plan(seen[0])


def test_calls_into_the_state_do_not_grow_with_the_keys():
    class Handle:
        """One value by name, and timers; counts what is asked of it."""

        def __init__(self, held=None, calls=None, name=None):
            self.held, self.calls, self.name = {} if held is None else held, [] if calls is None else calls, name

        def getValueState(self, name, schema, ttl=None):
            return Handle(self.held, self.calls, name)

        def get(self):
            self.calls.append("get")
            return self.held.get(self.name)

        def update(self, value):
            self.calls.append("update")
            self.held[self.name] = value

        def clear(self):
            self.calls.append("clear")
            self.held.pop(self.name, None)

        def registerTimer(self, at):
            self.calls.append(at)

        deleteTimer = registerTimer

    gap, keys = 1000, 300
    for n in (1, keys):
        handle, job = Handle(), episodes.Episodes(gap)
        job.init(handle)
        now = lambda ms: episodes.TimerValues(0, ms)
        rows = [(0, k, us, us % 7) for us in (9000, 0, 500, 20_000) for k in range(n)]
        first = list(job.handleInputRows((0,), iter(rows), now(0)))
        second = list(job.handleInputRows((0,), iter([(0, k, 20_900, None) for k in range(n)]), now(12)))
        third = list(job.handleExpiredTimer((0,), now(40), None))
        assert not first and len(second) == 2 * n and len(third) == n
        assert [tuple(r)[1:] for r in second + third if r[0] == n - 1] == [(0, 500, 2, 2, 2, 0, 0, False), (9000, 9000, 1, 1, 1, 2, 0, True), (20_000, 20_900, 2, 1, 1, 1, 0, True)]
        assert len(handle.calls) < 20


@pytest.mark.parametrize("most", [1000, 6, 1])
def test_no_pair_of_pools_is_shuffled_with_its_members(spark, monkeypatch, most):
    """Forty pools: members of few and of many, one in all, null ones; with `most` 1 nearly all members are busy."""
    monkeypatch.setattr(actors, "MOST_POOLS", most)
    rows = [(k, m) for k in range(40) for m in range(60) if (k * m) % 7 < 3 or m == 5 or (m % 10 == k // 4)] + [(k, None) for k in range(0, 40, 3)] + [(None, 5), (50, 5), (51, 5)]
    out = actors.overlap(spark.createDataFrame(rows * 2, "pool long, who long"), "pool", "who", 0.4)
    sets = {k: {m for j, m in rows if j == k} for k, _ in rows if k is not None}
    want = {}
    for a in sets:
        for b in sets:
            both = len((sets[a] & sets[b]) - {None})
            union = len(sets[a]) + len(sets[b]) - both
            if a < b and both / union >= 0.4:
                want[a, b] = (both, union)
    assert {(r["a"], r["b"]): (r["both"], r["union"]) for r in out.collect()} == want
    if most == 1000:
        # The join on members is the only one with them; what follows has pairs and sizes.
        assert "row_number" not in plan(out) and len(re.findall(r"Join Inner, .*who#", plan(out))) == 1


@pytest.mark.parametrize("query", ["promote_terms", "term_counts"])
def test_phrases_are_shuffled_once(spark, data, query):
    steps = texts.QUERIES[query](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(", steps)) == 1


PIECES = "The the Para 9para a1b 12abc x ab \u212aelvin \u0130stanbul caf\u00e9bar foo Foo fOO_bar bar-baz new\nline 1a2 1ab2c \u4e2dabc que quedo lasso".split(" ")


def odd_texts(n: int) -> list[str | None]:
    r = random.Random(7)
    return [None if k % 97 == 0 else "" if k % 89 == 0 else r.choice([" ", "", ", ", "9", " \n"]).join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for k in range(n)]


def terms_of(text: str | None) -> set[str]:
    w = [t for t in map(str.lower, re.findall(T.TOKEN, text or "")) if t not in T.STOP_WORDS]
    return {*w, *map(" ".join, zip(w, w[1:]))}


def plain_counts(rows: list[tuple]) -> set[tuple]:
    seen = defaultdict(lambda: (set(), set(), set()))
    for k, text, source, recent in rows:
        for t in terms_of(text) if recent is not None else ():
            seen[t][0 if recent else 1].add(k)
            if recent and source is not None:
                seen[t][2].add(source)
    return {(t, len(new), len(old), len(sources)) for t, (new, old, sources) in seen.items() if len(new) >= 2}


@pytest.mark.parametrize("sources, size", [(7, 1 << 24), (7, 500), (90, 500)])
def test_phrase_counts_of_odd_texts(spark, monkeypatch, sources, size):
    monkeypatch.setattr(T, "BLOCK", size, raising=False)
    rows = [(k, t, None if k % 31 == 0 else f"s{k % sources}", None if k % 41 == 0 else k % 3 == 0) for k, t in enumerate(odd_texts(600))]
    df = spark.createDataFrame(rows, "k long, t string, s string, recent boolean").repartition(3)
    got = T.phrase_counts(df, "k", "t", "s", df["recent"], 2).collect()
    assert len(got) == len({r["term"] for r in got}) and {tuple(r) for r in got} == plain_counts(rows)


def test_a_term_is_one_row_a_block(monkeypatch):
    texts_ = [t for t in odd_texts(300) if t]
    n = len(texts_)
    batch = pa.RecordBatch.from_pydict({"text": texts_, "part": pa.nulls(n, pa.string()), "recent": [k % 2 for k in range(n)], "past": [1 - k % 2 for k in range(n)], "bit": [1 << k % 5 for k in range(n)]})
    blocks = list(T.text_blocks(iter([batch.slice(0, 40), batch.slice(40)]), 2000))
    assert len(blocks) > 3 and pa.Table.from_batches(blocks).equals(pa.Table.from_batches([batch]).combine_chunks())
    whole = pa.Table.from_batches(T.block_counts(batch)).to_pydict()
    assert len(whole["term"]) == len(set(whole["term"])) and set(whole["term"]) == set().union(*map(terms_of, texts_))
    # Blocks whose numbers would not fit are halved.
    monkeypatch.setattr(T, "MOST_PLACES", 1000)
    total = defaultdict(lambda: [0, 0, 0])
    for r in pa.Table.from_batches(T.block_counts(batch)).to_pylist():
        t = total[r["term"]]
        t[:] = t[0] + r["n_recent"], t[1] + r["n_past"], t[2] | r["bits"]
    assert dict(total) == {t: list(c) for t, *c in zip(*(whole[c] for c in ("term", "n_recent", "n_past", "bits")))}
