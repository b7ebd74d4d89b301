"""Secret scans against a plain version of all kinds, and on texts of a megabyte."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import secrets

BASE64 = secrets.BASE64_CLASS.alphabet


def entropy(text: str, alphabet: str, width: int) -> float:
    top = 0.0
    for i in range(max(1, len(text) - width + 1)):
        part = text[i : i + width]
        counts = Counter(c if c in alphabet else "" for c in part)
        top = max(top, -sum(n / len(part) * math.log2(n / len(part)) for n in counts.values()))
    return top


def brute_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by plain patterns and a window that is counted anew at each place."""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for m in re.finditer("[A-Za-z0-9+/=_-]+", text):
        s = m[0]
        if len(s) < 20 or not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
            continue
        plain = re.fullmatch(r"([A-Za-z]+|[0-9]+)([-_/=+]+([A-Za-z]+|[0-9]+))*[-_/=+]*", s)
        if plain or any(re.search(p, s) for p in secrets.ALLOWED[:4]):
            continue
        c = secrets.HEX_CLASS if re.fullmatch("[0-9a-f]+", s) else secrets.BASE64_CLASS
        if entropy(s, c.alphabet, 20) >= c.threshold:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def samples() -> list[str]:
    rng = random.Random(11)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    out = ["", "é" * 30, "漢字 token: abcdef12", "password=example-1234567", "a1" * 15, "AKIA" + "A1" * 8]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice([pick(BASE64, rng.randrange(15, 60)), pick("0123456789abcdef", rng.randrange(18, 40)), pick("ab12", 25), f"TOKEN = '{pick(BASE64, rng.randrange(3, 12))}'", "AKIA" + pick("ABC123", rng.randrange(10, 30)), "2024-01-02-" + pick("abc1", 15), "word-" * 5 + "7", "漢字é"]))
        out.append(rng.choice([" ", "; ", "\n", "é"]).join(parts))
    return out


@pytest.mark.parametrize("width", [5, 20, 31])
@pytest.mark.parametrize("alphabet", [BASE64, secrets.HEX_CLASS.alphabet])
def test_window_entropy(spark, width, alphabet):
    rng = random.Random(width)
    texts = ["".join(rng.choice(BASE64 + "é!") for _ in range(rng.randrange(1, 90))) for _ in range(50)] + ["a", "a" * 60]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(secrets.window_entropy(F.col("t"), alphabet, width)).collect()
    assert [g[0] for g in got] == pytest.approx([entropy(t, alphabet, width) for t in texts], abs=1e-9)


def test_all_kinds_of_spans(spark):
    texts = samples()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["x"]] for r in df.select("doc_id", secrets.secret_spans(F.col("text")).alias("x")).collect()}
    want = {i: brute_spans(t) for i, t in enumerate(texts)}
    assert got == want
    assert {k for spans in want.values() for _, k, _ in spans} == {0, 1, 2, 3}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    for i, t in enumerate(texts):
        out, at = "", 0
        for s, _, e in want[i]:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert clean[i] == out + t[at:]


LONG = {
    "letters and digits in turn": "a-1-" * 300_000,
    "one string": "".join(random.Random(1).choice(BASE64) for _ in range(1_000_000)),
    "many matches": "password=abcdef12 " * 60_000,
    "many hexadecimals": ("0123456789abcdef" * 2 + " ") * 30_000,
    "blanks before no sign": "password" + " " * 1_000_000,
    "one long access key": "AKIA" * 250_000,
    "quotes": "token=\"" * 150_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_a_megabyte(spark, name):
    df = spark.createDataFrame([(1, LONG[name])], "doc_id long, text string")
    r = secrets.report(df).first()
    want = brute_spans(LONG[name]) if name != "one string" else None
    if want is not None:
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in want) for kind in range(3)]
        assert r["spans"] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
    text = secrets.redacted(df).first()["text"]
    assert (text == LONG[name]) == (r["spans"] == "")


def test_clashing_names_and_ties(spark):
    df = spark.createDataFrame([(1, "password=abcdef12", "x", "y"), (1, "password=abcdef12", "x", "y"), (None, None, None, None)], "doc_id long, text string, spans string, Spans_ string")
    assert sorted(map(tuple, secrets.redacted(df).collect()), key=repr) == sorted([(1, "[SECRET]", "x", "y")] * 2 + [(None, None, None, None)], key=repr)
    assert secrets.report(df).where("doc_id = 1").select("spans").collect() == [("assign:0:17",)] * 2
    assert secrets.redacted(df.limit(0)).count() == secrets.report(df.limit(0)).count() == 0
