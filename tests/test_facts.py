"""Facts, quantities, phrases and clusters on clauses written by hand, and the fixture queries against plain versions."""

from __future__ import annotations

import difflib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import facts
from tidemark.operators.facts import clusters, quantities, skeleton, with_facts
from tidemark.operators.text import prune_substrings, span_grams
from tidemark.plans import texts

QUERIES = registry.queries()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_quantities_of_every_unit(spark):
    cases = {
        "3万亿元": ("CNY", 3e12, "CNY:3000000000000"),
        "1,250亿元": ("CNY", 1.25e11, "CNY:125000000000"),
        "2 万元": ("CNY", 20000.0, "CNY:20000"),
        "2千元": ("CNY", 2000.0, "CNY:2000"),
        "7.50元": ("CNY", 7.5, "CNY:7.5"),
        "15％": ("fraction", 0.15, "fraction:0.15"),
        "2.5%": ("fraction", 0.025, "fraction:0.025"),
        "1.5GW": ("MW", 1500.0, "MW:1500"),
        "20mw": ("MW", 20.0, "MW:20"),
        "500kW": ("MW", 0.5, "MW:0.5"),
        "8万吨": ("tonne", 80000.0, "tonne:80000"),
        "8千吨": ("tonne", 8000.0, "tonne:8000"),
        "8吨": ("tonne", 8.0, "tonne:8"),
        "3亿股": ("share", 3e8, "share:300000000"),
        "3万股": ("share", 30000.0, "share:30000"),
        "3股": ("share", 3.0, "share:3"),
        "3亿": ("count", 3e8, "count:300000000"),
        "3万": ("count", 30000.0, "count:30000"),
        **{f"4{u}": (u, 4.0, f"{u}:4") for u in "台套个家"},
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", quantities("t").alias("q"))
    assert {r["t"]: [(q["unit"], q["value"], q["key"]) for q in r["q"]] for r in df.collect()} == {t: [c] for t, c in cases.items()}
    q = spark.createDataFrame([("共美元3万元和5kg，7",)], "t string").select(quantities("t").alias("q")).first()["q"]
    assert [(x["raw"], x["unit"], x["start"], x["end"]) for x in q] == [("3万元", "USD", 3, 6)]
    s = spark.createDataFrame([("营收 1,000万元！",), ("营收1000 万元",), (None,)], "t string").select(skeleton("t").alias("s"))
    assert [r["s"] for r in s.collect()] == ["营收<cny10000000>", "营收<cny10000000>", ""]


def test_facts_of_clauses(spark):
    text = "公司签订合同，金额1,250亿元；否认财务造假。2023年度净利润增长15％。净利润2023年度 增长；净利润2023年度增长。但确认减值2千元\n否认违约且确认退市；召开2024年第一次临时股东大会；违约不属实；nothing"
    got = with_facts(spark.createDataFrame([(text,), (None,), ("",)], "t string"), "t", "f").collect()
    assert got[1]["f"] == got[2]["f"] == []
    keep = lambda f: (f["evidence"], f["actions"], f["numbers"], f["period"], f["direction"], f["negative_terms"], f["denied_terms"], f["event_class"], f["importance"])
    assert [keep(f) for f in got[0]["f"]] == [
        ("公司签订合同", ["order"], [], [], "unknown", [], [], "economic", 0.75),
        ("金额1250亿元", [], ["CNY:125000000000"], [], "unknown", [], [], "mention", 0.1),
        ("否认财务造假", ["investigation"], [], [], "denied", [], ["财务造假"], "economic", 0.8),
        ("2023年度净利润增长15％", ["results"], ["fraction:0.15"], ["2023年度"], "unknown", [], [], "economic", 0.85),
        ("净利润2023年度 增长", ["results"], [], ["2023年度"], "unknown", [], [], "economic", 0.85),
        ("确认减值2千元", ["impairment"], ["CNY:2000"], [], "negative", ["减值"], [], "economic", 0.8),
        ("否认违约且确认退市", [], [], [], "negative", ["退市"], ["违约"], "mention", 0.1),
        ("召开2024年第一次临时股东大会", [], [], ["2024年"], "unknown", [], [], "routine", 0.0),
        ("违约不属实", [], [], [], "denied", [], ["违约"], "mention", 0.1),
        ("nothing", [], [], [], "unknown", [], [], "mention", 0.1),
    ]


def test_facts_without_mentions(spark):
    """The same as all facts without mentions, places too; clauses behind the last that may be more are not looked at."""
    words = [w for p in facts.ACTIONS.values() for w in p.split("|")]
    r = random.Random(4)
    pieces = [*words, "股东大会1亿元通知", "３股东大会通知", "<share:3>东大会通知", "订 单", "订单", "1,000万元 合同", "1000万元合同", "<cny10000000>合同", "plain words", "GW", "3家产 品", "会议资料", "董事会决议", "。", "，", "\n", "但是", " "]
    rows = [(k, "".join(r.choice(pieces) for _ in range(r.randrange(14)))) for k in range(300)] + [(300, None), (301, ""), (302, "plain. words"), (303, "合同, plain words, and more, and more")]
    df = spark.createDataFrame(rows, "k int, t string")
    fields = lambda out: sorted(str(tuple(x)) for x in out.collect())
    want = fields(facts.fact_rows(df, "t").where("event_class <> 'mention'"))
    assert len(want) > 300 and fields(facts.fact_rows(df, "t", mentions=False)) == want
    assert facts._told(df.where("k >= 301"), "t", "told", mentions=False).selectExpr("size(told) AS n").collect() == [(0,), (0,), (1,)]
    for pattern in (*words, "东大会", "董事会", "会议资料", "制度修订", "章程修订", "东名册", "法律意见书"):
        assert set(pattern) & set(facts.SIGNS)


def test_all_numbers_and_actions_of_a_clause(spark):
    f = with_facts(spark.createDataFrame([("订单1万 2万 3万 4万 5万 6万和产能价格",)], "t string"), "t", "f").first()["f"]
    assert [(x["actions"], len(x["numbers"])) for x in f] == [(["order", "capacity", "price"], 6)]


def test_clusters_are_greedy_in_order(spark):
    df = spark.createDataFrame([("k", 1, "profit rises by ten"), ("k", 2, "profit rises by tan"), ("k", 3, "other words here"), ("j", 4, "profit rises by ten")], "key string, seq int, text string")
    out = clusters(df, ["key"], ["seq"], "text").select("key", "seq", "cluster")
    assert rows(out) == [("j", 4, 0), ("k", 1, 0), ("k", 2, 0), ("k", 3, 1)]


def test_clusters_by_text_link_and_day(spark):
    data = [
        ("k", 1, "profit rises by ten", 1, None, True),
        ("k", 2, "profit rises by tan", 2, None, True),  # alike, but on another day
        ("k", 3, "profit rises by ten", 9, None, True),  # the very text, on any day
        ("k", 4, "quite other words", 3, "u", True),
        ("k", 5, "nothing in common 77", 4, "u", True),  # the link alone
        ("k", 6, "profit rises by tin", 2, None, False),  # alike, but not to be compared
        ("k", 7, "profit rises by tap", 2, None, True),
    ]
    df = spark.createDataFrame(data, "key string, seq int, text string, day int, link string, acts boolean")
    out = clusters(df, ["key"], ["seq"], "text", day="day", link="link", alike="acts")
    assert {r["seq"]: r["cluster"] for r in out.collect()} == {1: 0, 2: 1, 3: 0, 4: 2, 5: 2, 6: 3, 7: 3}


def test_a_cluster_is_joined_however_old(spark):
    """2100 other groups of the key stand between a text and its repeat, and between it and one that is alike."""
    data = [(k, f"{k:04d}", 0, False) for k in range(2100)] + [(2200, "0000", 1, False), (2201, "00000", 0, True), (2202, "0777", 0, True)]
    out = clusters(spark.createDataFrame([("k", *r) for r in data], "key string, seq int, text string, day int, acts boolean"), ["key"], ["seq"], "text", day="day", alike="acts")
    got = {r["seq"]: r["cluster"] for r in out.collect()}
    assert got == plain_clusters([("k", *r, None) for r in data])
    assert got[2200] == 0 and len(set(got.values())) == 2100


def plain_clusters(rows, least=0.72):
    """(key, seq, text, day, alike, link) in order, one after the other, all groups held."""
    out, keys = {}, {}
    for key, seq, text, day, may, link in sorted(rows, key=lambda r: r[1]):
        groups, by_text, by_link = keys.setdefault(key, ([], {}, {}))
        text = text or ""
        known = [k for k in (by_text.get(text), by_link.get(link) if link else None) if k is not None]
        if may:
            known += [n for n, (first, then) in enumerate(groups) if then == day and difflib.SequenceMatcher(None, first, text, autojunk=False).ratio() >= least]
        hit = max(known, default=len(groups))
        if hit == len(groups):
            groups.append((text, day))
        by_text[text] = max(hit, by_text.get(text, -1))
        if link:
            by_link[link] = max(hit, by_link.get(link, -1))
        out[seq] = hit
    return out


@pytest.mark.parametrize("held, compared", [(1024, 4096), (3, 5)])
@pytest.mark.parametrize("linked", [False, True])
def test_clusters_equal_a_plain_run(spark, monkeypatch, held, compared, linked):
    """Null keys, days, texts and links, equal and empty texts, chains of links; blocks of three first texts and parts of five rows."""
    monkeypatch.setattr(facts, "HELD", held)
    monkeypatch.setattr(facts, "COMPARED", compared)
    r = random.Random(5)
    texts_ = [None, "", "a", "é中文", *("".join(r.choice("ab中") for _ in range(r.randint(2, 12))) for _ in range(60))]
    links = [None, None, None, "", *(f"u{k}" for k in range(15))] if linked else [None]
    rows = [(r.choice([None, "k", "k", "j"]), seq, r.choice(texts_), r.choice([None, 1, 1, 2]), r.choice([True, True, True, False, None]), r.choice(links)) for seq in range(400)]
    df = spark.createDataFrame(rows, "key string, seq int, text string, place int, acts boolean, link string").repartition(3)
    out = clusters(df, ["key"], ["seq"], "text", day="place", link="link" if linked else None, alike="acts").collect()
    assert len(out) == len(rows) and {r["seq"]: r["cluster"] for r in out} == plain_clusters(rows)


def test_first_texts_that_are_alike(monkeypatch):
    monkeypatch.setattr(facts, "HELD", 8)
    r = random.Random(8)
    texts_ = ["", "a", *("".join(r.choice("abc中文") for _ in range(r.randint(1, 9))) for _ in range(120))]
    known = facts.Firsts(0.6)
    for k, t in enumerate(texts_):
        known.add(t, k)
    for t in texts_:
        for since, until in ((0, len(texts_)), (5, 60), (7, 7)):
            want = [k for k in range(since, until) if difflib.SequenceMatcher(None, texts_[k], t, autojunk=False).ratio() >= 0.6]
            assert known.newest(t, since, until) == max(want, default=None)


def test_phrases_of_spans(spark):
    got = spark.createDataFrame([("固态电池的 AB",), ("公司液冷",), ("长长长长长长长长长长",), ("",), (None,)], "t string").select(span_grams(F.col("t")).alias("g")).collect()
    assert sorted(got[0]["g"]) == sorted(["固态", "态电", "电池", "固态电", "态电池", "固态电池"])
    assert got[1]["g"] == ["液冷"]
    assert sorted(map(len, got[2]["g"])) == list(range(2, 9))
    assert got[3]["g"] == [] and got[4]["g"] is None


def plain_pruning(terms: dict[str, int], factor: float) -> dict[str, int]:
    stays: dict[str, int] = {}
    for t in sorted(terms, key=lambda t: -len(t)):
        if not any(t in longer and len(longer) > len(t) and terms[t] <= factor * stays[longer] for longer in stays):
            stays[t] = terms[t]
    return stays


def test_pruning_of_substrings(spark):
    terms = {"abcd": 10, "abc": 11, "bcd": 12, "ab": 12, "bc": 30, "cd": 13, "xy": 5, "wxyz": 1, "xyz": 4}
    df = spark.createDataFrame(list(terms.items()), "term string, n long")
    assert dict(rows(prune_substrings(df, 1.15, lambda d: d))) == plain_pruning(terms, 1.15)


def test_fixture_queries_against_plain_versions(spark, data):
    counts = {r["term"]: r["n"] for r in QUERIES["phrase_grams"](spark, data).collect()}
    assert dict(rows(QUERIES["phrase_substrings"](spark, data))) == plain_pruning(counts, 1.15)
    docs = {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    events = QUERIES["events_extract"](spark, data).where("place < 3").collect()
    notes = {0: ["order", "", "investigation"], 1: ["", "results", "results"], 4: ["capacity", "capacity", ""]}
    by_doc = {}
    for r in events:
        by_doc.setdefault(r["doc_id"], {})[r["place"]] = r["actions"]
    assert set(by_doc) == docs
    for i, found in by_doc.items():
        if i % 6 == 0:
            assert [found[k] for k in range(3)] == notes[0]
    quantity = Counter(r["unit"] for r in QUERIES["quantities"](spark, data).where("key in ('MW:1500', 'tonne:80000', 'USD:30000')").collect())
    fives = sum(i % 6 == 4 for i in docs)
    assert quantity == {"MW": fives, "tonne": fives, "USD": fives}
    clustered = QUERIES["fact_clusters"](spark, data).collect()
    assert {r["cluster"] for r in clustered if r["numbers"] == "CNY:3000000000000"} == {0}
    notes_of = QUERIES["annotate"](spark, data).collect()
    assert {r["doc_id"] for r in notes_of} == docs
    want = {0: "denied", 2: "negative_candidate", 5: "denied"}
    assert all(r["direction"] in (want[r["doc_id"] % 6], "negative_candidate") for r in notes_of if r["doc_id"] % 6 in want)
    assert len(texts.NOTES) == 6
