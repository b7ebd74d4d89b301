"""Alignment of two tokenizers against a plain version by the libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import align, bpe

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def tokens(text):
    """(id, bytes) of A and B, by the libraries alone."""
    json = Tokenizer.from_file(A)
    json.encode_special_tokens = True
    alphabet = bpe.byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in json.id_to_token(i))) for i in json.encode(" " + text, add_special_tokens=False).ids]
    p = sentencepiece.SentencePieceProcessor(model_file=B)
    b = [(i, bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()) for i in p.encode(text)]
    return a, b


def plain(rows):
    found, docs = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            a, b = tokens(text)
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) == whole and b"".join(x for _, x in b) == whole:
                k = at_a = at_b = 0
                open_a, open_b = [], []
                while k < len(a):
                    open_a.append(a[k][0])
                    at_a += len(a[k][1])
                    k += 1
                    while at_b < at_a:
                        t, x = b.pop(0)
                        open_b.append(t)
                        at_b += len(x)
                    if at_a == at_b:
                        groups.append((open_a, open_b))
                        open_a, open_b = [], []
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        docs.update(links.keys())
        found.append((i, groups, links))
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for i, groups, links in found:
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def small(rows):
    rng = random.Random(8)
    odd = ["<|endoftext|> a <s></s><unk>", "a▁b", " ", "  \n\t ", "x  ", "<0x41>", "\x00", "é 👩‍👩‍👧 漢字かな", "don't 'll 12345", "ﬁ ½ Å", " 　  x", "w" * 300]
    return [(i, t) for i, t in rows if t is None or len(t) < 4000] + [(200 + i, t) for i, t in enumerate(odd)] + [(300 + i, "".join(rng.choice("ab é漢\n'.1 ") for _ in range(rng.randrange(40)))) for i in range(40)]


@pytest.fixture(scope="module")
def table(spark, small):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in small], "doc_id long, text string, pair string, n long").repartition(3)


@pytest.mark.parametrize("held,frequent", [(1 << 20, 1 << 17), (20, 1 << 17), (1 << 20, 1), (20, 300)])
def test_equals_plain(spark, table, small, held, frequent):
    out = align.aligned(table, A, B, links_held=held, frequent=frequent)
    assert sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out.collect()), key=repr) == plain(small)


def test_long_texts_over_many_runs(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é漢\n'.1  ") for _ in range(120_000)), "word " * 60_000, "w" * 100_000]
    rows = list(enumerate(texts))
    out = {r["doc_id"]: r for r in align.aligned(spark.createDataFrame(rows, "doc_id long, text string"), A, B, links_held=500).collect()}
    for i, t in rows:
        a, b = tokens(t)
        assert (out[i]["n_a"], out[i]["n_b"]) == (len(a), len(b))
    assert out[0]["n_groups"] > 10_000
    assert out[2]["n_links"] >= out[2]["n_a"]
    one = align.aligned(spark.createDataFrame(rows[:2], "doc_id long, text string"), A, B).collect()
    for r in one:
        assert (r["n_groups"], r["groups_sha256"], r["n_links"]) == (out[r["doc_id"]]["n_groups"], out[r["doc_id"]]["groups_sha256"], out[r["doc_id"]]["n_links"])


def test_a_group_of_many_tokens_is_multiplied():
    import numpy as np

    ids = (np.array([5] * 300 + [6, 7]), np.array([8] * 200 + [9, 9]))
    group = (np.array([0] * 300 + [1, 1]), np.array([0] * 200 + [1, 1]))
    keys, times = align.links_of(ids, group, np.array([0, 1]))
    got = {(int(k) >> 42, (int(k) >> 21) & 0x1FFFFF, int(k) & 0x1FFFFF): int(n) for k, n in zip(keys, times, strict=True)}
    assert got == {(0, 5, 8): 60_000, (1, 6, 9): 2, (1, 7, 9): 2}


def test_links_and_empty(spark, small, empty):
    rows = [(1, "hello  world"), (1, "hello"), (2, None)]
    got = {(r["doc_id"], r["a"], r["b"]): r["times"] for r in align.links(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    a, b = tokens("hello")
    assert got[1, a[0][0], b[0][0]] == 2
    assert align.aligned(empty, A, B).count() == 0
