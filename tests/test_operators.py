"""Boundary rules on small tables written by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import midrank, number, ratio
from tidemark.operators import asof, bitemporal, learn, ranking, series
from tidemark.operators.text import nfkc


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replay_does_not_see_later_knowledge(spark):
    early = spark.createDataFrame([(1, 10, 11), (2, 20, 25)], "id int, us long, obs_us long")
    late = early.unionByName(spark.createDataFrame([(3, 12, 90)], early.schema))
    assert rows(bitemporal.as_of(early, 30)) == rows(bitemporal.as_of(late, 30))


def test_half_open_interval(spark):
    df = spark.createDataFrame([(1, 10, 10), (2, 20, 20)], "id int, us long, obs_us long")
    assert rows(bitemporal.as_of(df, 99, 10, 20)) == [(1, 10, 10)]


def test_asof_tolerance_edges(spark):
    left = spark.createDataFrame([("a", 100), ("a", 111), ("b", 100), (None, 5)], "k string, at long")
    right = spark.createDataFrame([("a", 90, 1), ("a", 100, 2)], "k string, t long, v int")
    out = asof.backward_asof(left, right, ["k"], "at", "t", 10, ["v"]).select("k", "at", "asof_v")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", 100, 2), ("a", 111, None), ("b", 100, None), (None, 5, None)], key=repr)
    out = asof.forward_asof(left.where("k = 'a'").withColumn("at", F.col("at") - 20), right, ["k"], "at", "t", 10, ["v"]).select("at", "asof_t")
    assert rows(out) == [(80, 90), (91, 100)]


def test_coverage(spark):
    df = spark.createDataFrame([("gap", 0, 5, 0, 10), ("gap", 6, 10, 0, 10), ("full", 0, 5, 0, 10), ("full", 5, 12, 0, 10), ("short", 0, 9, 0, 10)], "k string, s long, e long, lo long, hi long")
    assert dict(rows(asof.covers(df, ["k"], "s", "e", "lo", "hi"))) == {"gap": False, "full": True, "short": False}


def test_island_breaks_only_beyond_the_gap(spark):
    df = spark.createDataFrame([("x", 0), ("x", 10), ("x", 21)], "k string, t long")
    out = series.islands(df, ["k"], "t", 10, F.lit(True)).select("t", "run", "first_of_series")
    assert rows(out) == [(0, 1, True), (10, 1, False), (21, 2, False)]


def test_midrank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None)], "id int, x double").select("id", midrank(F.col("x")).alias("m"))
    got = {r["id"]: r["m"] for r in df.collect()}
    assert got[4] is None
    assert got[1] == pytest.approx(0.5 / 3)
    assert got[2] == got[3] == pytest.approx(2 / 3)


def test_ratio_and_number(spark):
    df = spark.createDataFrame([("1,200.5",), ("5%",), ("nan",), ("x",), (None,)], "t string").select("t", number(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == {"1,200.5": 1200.5, "5%": 5.0, "nan": None, "x": None, None: None}
    assert spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("r")).first()["r"] is None


def test_first_write_wins(spark):
    new = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "key string, seq int, v string")
    assert rows(bitemporal.first_wins(new, new.where("key = 'b'"), "key", "seq")) == [("a", 1, "y")]


def test_two_heads_leave_the_unmeasured_out(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0)], "id int, s double").withColumn("k", F.lit(1))
    out = ranking.two_head_rank(df, {"a": "s"}, ["k"], "id").select("id", "rank_a")
    assert {r["id"]: r["rank_a"] for r in out.collect()} == {1: 1, 3: 2, 2: None}


def test_folds_keep_their_distance():
    for f in learn.walk_forward(0, 10, 4, 4, 1, 4, 3):
        assert f.train[1] < f.validation[0] and f.validation[1] < f.test[0]


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    got = {r["feature"]: r["coefficient"] for r in learn.ridge(spark, df, ["a", "b"], "y", 1.0).collect()}
    w = np.clip(x, np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0))
    z = (w - w.mean(0)) / w.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert [got["a"], got["b"]] == pytest.approx(list(want), abs=1e-5)


def test_text_functions(spark):
    assert spark.createDataFrame([("ﬁ１",)], "t string").select(nfkc("t").alias("x")).first()["x"] == "fi1"
