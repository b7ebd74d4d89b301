"""Pages of one template: similar beyond any place bound of a corpus-wide order, but not linked."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.llm import jaccard_join

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = SPACED.findall(text.lower())
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}


def family(n, seed=1, passages=24, size=70):
    """Documents of one template with two of some passages that all the corpus uses."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    template = [word() for _ in range(size)]
    parts = [[word() for _ in range(9)] for _ in range(passages)]
    out = []
    for _ in range(n):
        a, b = rng.sample(parts, 2)
        out.append(" ".join(template[: size // 3] + a + template[size // 3 : size // 2] + b + template[size // 2 :] + [word() for _ in range(2)]))
    # Elsewhere the passages are common, so they come late in the corpus's order.
    return out + [" ".join([word() for _ in range(40)] + p + [word() for _ in range(30)]) for p in parts for _ in range(12)]


def components(texts):
    sets = [shingles(t) for t in texts]
    best = list(range(len(texts)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                best[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.fixture
def counted(monkeypatch):
    seen = []
    plain = jaccard_join._rest

    def rest(live):
        out = plain(live)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_rest", rest)
    return seen


@pytest.mark.parametrize("n", [200, 400, 800])
def test_pairs_stay_near_proportion(spark, counted, n):
    texts = family(n)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.report(df).collect()}
    if n == 200:
        assert [got[i] for i in range(len(texts))] == components(texts)
    print(n, counted)
    assert sum(counted) <= 10 * len(texts)
