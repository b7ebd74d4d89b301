"""Sliding actors, patches and dictionary terms against plain versions on awkward rows."""

from __future__ import annotations

import json
import random
import re

import pytest

from tidemark import on_workers
from tidemark.operators import actors, patches, text

MINUTE, DAY = 60_000_000, 86_400_000_000


def test_sliding_actors_equal_plain_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(2 * DAY // MINUTE) * MINUTE + rng.choice([0, 0, 1, 30_000_000]), rng.randrange(6)) for _ in range(500)]
    rows += [("a", m * MINUTE, 1) for m in (0, 5, 565, 569, 570, 571, 575, 1434, 1435, 1439, 1440)] * 2 + [("a", None, 1), ("a", 5, None), ("c", -3 * MINUTE, 2)]
    got = {(r["k"], r["end"]): (r["actors_15"], r["actors_60"]) for r in actors.sliding_actors(spark.createDataFrame(rows, "k string, us long, who long"), ["k"], "us", "who", (15, 60)).collect()}
    want = {}
    for k in "abc":
        for end in range(-DAY, 3 * DAY, 5 * MINUTE):
            at = end % DAY
            opened = end - at + (570 * MINUTE if at > 570 * MINUTE else 0)
            n = tuple(len({w for kk, t, w in rows if kk == k and t is not None and w is not None and max(end - m * MINUTE, opened) <= t < end}) for m in (15, 60))
            if n[1]:
                want[k, end] = n
    assert got == want


def test_patches_equal_a_plain_fold(spark):
    raw = {
        1: ['{"a":1,"m":{"x":1,"y":{"z":[1,NaN,{"q":-Infinity}]}}}', '{"a":1}', '{"m":{"x":null}}', '{"m":{"y":3}}', '{"m":{"y":{"k":Infinity}}}', "[1,NaN]", '{"b":{}}', "oops", None, '{"b":{}}', '{"b":null}'],
        2: ["{}", "{}", '{"n":null}', '{"n":{"d":{"e":null}}}', "null", "7"],
        None: ['{"z":1}'],
    }
    rows = [(k, i, p) for k, ps in raw.items() for i, p in enumerate(ps)]
    random.Random(1).shuffle(rows)
    out = patches.versions(spark.createDataFrame(rows, "k long, i int, p string").repartition(3), "k", ["i"], "p")
    on_workers(spark)
    got = sorted(((r["k"] or 0, r["version"], r["i"], json.loads(r["j"])) for r in out.selectExpr("k", "i", "version", "to_json(document) AS j").collect()), key=lambda r: r[:2])
    assert got == [
        (0, 1, 0, {"z": 1}),
        (1, 1, 0, {"a": 1, "m": {"x": 1, "y": {"z": [1, None, {"q": None}]}}}),
        (1, 2, 2, {"a": 1, "m": {"y": {"z": [1, None, {"q": None}]}}}),
        (1, 3, 3, {"a": 1, "m": {"y": 3}}),
        (1, 4, 4, {"a": 1, "m": {"y": {"k": None}}}),
        (1, 5, 5, [1, None]),
        (1, 6, 6, {"b": {}}),
        (1, 7, 10, {}),
        (2, 1, 0, {}),
        (2, 2, 3, {"n": {"d": {}}}),
        (2, 3, 4, None),
        (2, 4, 5, 7),
    ]


def plain_topics(doc, dictionary):
    low = (doc or "").lower()

    def holds(term, inside):
        if inside is None:
            inside = not re.fullmatch(r"[a-zA-Z0-9 $/\-]+", term)
        return term.lower() in low if inside else bool(re.search(rf"(?<![A-Za-z0-9]){re.escape(term.lower())}(?![A-Za-z0-9])", low))

    explicit = {}
    for topic in {r[0] for r in dictionary}:
        terms = {r[1].lower() for r in dictionary if r[0] == topic and r[1] and holds(r[1], r[2])}
        contexts = [r[3] for r in dictionary if r[0] == topic and r[3]]
        if terms and (not contexts or any(holds(c, None) for c in contexts)):
            explicit[topic] = len(terms)
    above, parents = set(), {(r[0], r[4]) for r in dictionary if r[4]}
    todo = list(explicit)
    seen = set()
    while todo:
        t = todo.pop()
        for a, p in parents:
            if a == t and (t, p) not in seen:
                seen.add((t, p))
                above.add(p)
                todo.append(p)
    return {t: ("explicit", n) for t, n in explicit.items()} | {t: ("implied", 0) for t in above if t not in explicit}


@pytest.mark.parametrize("begins", [2000, 0])
def test_terms_anywhere_equal_plain_search(spark, monkeypatch, begins):
    monkeypatch.setattr(text, "MOST_BEGINS", begins)
    dictionary = [("battery", "固态电池", None, None, "energy"), ("battery", "电池", None, None, "energy"), ("ai", "AI", None, None, "tech"), ("cpo", "CPO", None, "光模块", "ai"), ("cooling", "液冷", None, "AI", "tech"), ("inner", "said", True, None, None), ("long", "an exact phrase - of $some/length 42", None, None, "inner"), ("energy", "能源", None, None, "root"), ("root", "ROOTS", None, None, "energy"), ("blank", "", None, None, "root"), ("one", "é", None, None, None)]
    docs = ["新型固态电池和AI", "he said AI. cpo 光模块", "CPO only", "saids xAI AI2 AIé", None, "", "液冷 ai", "x" * 511 + "AI y", "x " * 255 + "电池", "长" * 508 + "固态电池" + "长" * 600 + "AN EXACT PHRASE - OF $some/LENGTH 42", "能源", "roots", "A" * 1024 + "é"]
    rng = random.Random(2)
    docs += ["".join(rng.choice(["AI", "电", "池", "固态", " ", "CPO", "光模块", "said", "x", "é", "\n"]) for _ in range(rng.randrange(700))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, body string")
    out = text.match_anywhere(df, spark.createDataFrame(dictionary, "topic string, term string, inside boolean, context string, parent string"), "id", "body")
    got: dict[int, dict] = {i: {} for i in range(len(docs))}
    for r in out.collect():
        got[r["id"]][r["topic"]] = (r["how"], r["terms"])
    for i, d in enumerate(docs):
        assert got[i] == plain_topics(d, dictionary), i


@pytest.mark.parametrize("begins", [2000, 0])
def test_a_dictionary_too_large_to_send_finds_the_same(spark, monkeypatch, begins):
    monkeypatch.setattr(text, "MOST_BROADCAST", 3)
    test_terms_anywhere_equal_plain_search(spark, monkeypatch, begins)


def test_every_stage_has_its_case(spark):
    from tidemark.operators import ranking

    columns = "id string, family string, usable boolean, stale boolean, high boolean, rising boolean, long_history boolean, persistence int, velocity double, entered boolean, jumped boolean, observations int"
    live = lambda i, family="a", **x: (i, *({"family": family, "usable": True, "stale": False, "high": False, "rising": False, "long_history": True, "persistence": 3, "velocity": 0.0, "entered": False, "jumped": False, "observations": 1} | x).values())
    two = lambda i, **x: [live(i, "a", high=True, **x), live(i, "b", high=True, **x)]
    rows = [
        *two("negative_attention", rising=True), *two("risk_excluded"), *two("slows/decelerating", velocity=-1.0), *two("accelerating", rising=True), *two("held/high_heat"), live("newborn", entered=True), live("warming", rising=True),
        live("one/decelerating", high=True, velocity=-1.0), live("one/high_heat", high=True), live("information_new"), live("fading", velocity=-0.5), live("stale", stale=True), live("cold_start", long_history=False), live("stable"), *two("unknown/high_heat", velocity=None),
        live("jump/newborn", entered=True, jumped=True, observations=0), live("late/stable", entered=True, observations=0), live("unusable/stale", usable=False), *two("short/high_heat", persistence=1),
    ]
    info = {r[0] for r in rows} | {"insufficient"}
    news = [(i, 3 if i == "negative_attention" else 1, 0.5, i == "information_new", i == "risk_excluded") for i in info]
    out = {r["id"]: (r["stage"], r["band"]) for r in ranking.stages(spark.createDataFrame(rows, columns), spark.createDataFrame(news, "id string, negative int, negative_share double, material boolean, flagged boolean"), "id").collect()}
    assert {i: s for i, (s, _) in out.items()} == {i: i.rpartition("/")[2] for i in info}
    assert {out[i][1] for i in ("held/high_heat", "one/high_heat")} == {"confirmed", "monitor"}


def test_strongest_pairs_without_all_pairs(spark):
    from tidemark.operators import graph

    rng = random.Random(6)
    rows = [(f, min(int(rng.paretovariate(0.7)), 400)) for f in range(400) for _ in range(12)]
    df = spark.createDataFrame(rows, "fact int, member int")
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    held: dict[int, set] = {}
    for f, m in rows:
        held.setdefault(f, set()).add(m)
    plain: dict[tuple, int] = {}
    for own in held.values():
        for a in own:
            for b in own:
                if a < b:
                    plain[a, b] = plain.get((a, b), 0) + 1
    want = sorted(((-n, a, b) for (a, b), n in plain.items()))
    for k in (1, 10, 50, 10_000):
        best, made = graph.strongest_pairs(df, ["fact"], "member", k, keep, first=4)
        assert sorted((-r["n"], r["a"], r["b"]) for r in best.collect()) == want[:k]
        assert made <= sum(plain.values()) and (k > 10 or made < 0.5 * sum(plain.values()))
    assert graph.strongest_pairs(df.limit(0), ["fact"], "member", 5, keep)[0].count() == 0
