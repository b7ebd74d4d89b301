"""Ranks, cut points and adjusted p-values of whole columns without a task that orders all of it."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import learn, ranking
from tidemark.operators.text import ENTITIES
from tidemark.plans import base


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 200_000
    x = np.where(rng.random(n) < 0.3, 5.0, np.round(rng.normal(size=n) * 1000, 1))
    return pd.DataFrame({"id": np.arange(n), "k": rng.integers(0, 3, n), "x": np.where(rng.random(n) < 0.1, np.nan, x)})


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(4)


def test_average_ranks_and_heads(table, frame):
    out = ranking.average_ranks(table, "x", "rank").toPandas().sort_values("id")
    assert np.allclose(out["rank"].to_numpy(float), frame["x"].rank().to_numpy(), equal_nan=True)
    heads = ranking.two_head_rank(table, {"h": "x"}, ["k"], "id").toPandas().sort_values("id")
    want = frame.sort_values(["x", "id"], ascending=[False, True]).groupby("k").cumcount().add(1).where(frame["x"].notna()).sort_index()
    assert np.array_equal(heads["rank_h"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_plans_have_no_window_over_everything(table):
    for df in (ranking.average_ranks(table, "x", "rank"), ranking.percentile_scores(table, {"s": ["x"]}), ranking.terciles(table, "x", "k")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window " in line]
        # Windows without a key are over bins alone.
        assert all("bin#" in line or "sum(n#" in line for line in windows), windows


def test_terciles_and_scores(table, frame):
    got = {r["k"]: (r["n"], r["low"], r["high"]) for r in ranking.terciles(table, "x", "k").collect()}
    for k, g in frame.dropna().groupby("k"):
        v = np.sort(g["x"].to_numpy())
        assert got[k] == (len(v), v[len(v) // 3], v[2 * len(v) // 3])
    score = ranking.percentile_scores(table, {"s": ["x"]}).toPandas().sort_values("id")["s"].to_numpy(float)
    v = frame["x"]
    want = (v.rank(method="min") - 1 + 0.5 * v.groupby(v).transform("count")) / v.notna().sum() * 100
    assert np.allclose(score, want.to_numpy(), equal_nan=True)


def test_adjusted_p_values(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([np.full(300, 0.04), rng.random(700).round(3), [0.0, 1.0]])
    rows = [(i, float(x)) for i, x in enumerate(p)] + [(5000, None), (5001, None)]
    out = {r["test"]: r["q"] for r in learn.bh_adjust(spark.createDataFrame(rows, "test int, p double"), "test", "p").collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum(np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
    assert [out[int(i)] for i in order] == pytest.approx(list(q))
    assert out[5000] is None and out[5001] is None


def test_values_of_texts(spark, data):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in base.table(spark, data, "conversations").collect()}
    got = registry.queries()["nfkc"](spark, data).collect()
    assert len(got) == len(turns)
    assert all(r["digest"] == hashlib.sha256(unicodedata.normalize("NFKC", turns[r["conv_id"], r["turn"]] + " Ａｂｃ１２ ﬁ").encode()).hexdigest() for r in got)
    pages = {r["page_id"]: r["html"] for r in base.table(spark, data, "pages").collect()}
    texts = {r["page_id"]: r["text"] for r in registry.queries()["html_text"](spark, data).collect()}
    for i, html in pages.items():
        out = re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", html))
        for entity, char in ENTITIES:
            out = out.replace(entity, char)
        out = re.sub(r"[ \t\r\n]+", " ", out).strip(" ")
        assert texts.get(i) == (out if len(out) >= 40 else None), i
