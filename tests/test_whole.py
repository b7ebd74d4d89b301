"""Pairs of busy records, and one hot key."""

from __future__ import annotations

import time
from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import asof, calendar, learn

QUERIES = registry.queries()


@pytest.mark.parametrize("name, most", [("comention_pairs", 30), ("comention_pairs_all", 99)])
def test_pairs_of_a_busy_actor(spark, tmp_path, name, most):
    """One actor touches forty objects on one day, another three of them, through two sources."""
    rows = [(k, datetime(2024, 1, 5, 9, k), 1, "click", f'{{"k": {k}}}', 1.0) for k in range(40)] + [(50 + k, datetime(2024, 1, 5, 9, k), 2, s, f'{{"k": {k}}}', 1.0) for k in (3, 8, 39) for s in ("click", "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = {p: (1, 1) for p in combinations(range(min(40, most)), 2)}
    want |= {p: (2 if p in want else 1, 2) for p in combinations((3, 8, 39), 2)}
    assert {(r["a"], r["b"]): (r["n"], r["families"]) for r in QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_forward_asof_of_a_hot_key(spark):
    """The cost of one key follows its rows, not their square."""
    n = 200_000
    left = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("at"))
    right = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10 + 3).alias("t"), F.col("id").alias("v"))
    start = time.time()
    out = asof.forward_asof(left, right, ["k"], "at", "t", 5, ["v"])
    assert out.where("asof_v = at / 10").count() == n
    assert time.time() - start < 60


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=900), np.full(700, 0.25), [np.pi] * 3])
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    shares = [0.0, 0.01, 0.1, 0.5, 0.77, 0.99, 1.0]
    assert learn.quantiles(rows, "x", shares, bins=8) == pytest.approx(np.quantile(x, shares).tolist())
    assert learn.quantiles(spark.createDataFrame([(7.0,)], "x double"), "x", [0.0, 0.5]) == [7.0, 7.0]
    assert learn.quantiles(rows.where("x > 99"), "x", [0.5]) == [None]


def test_deadlines_over_breaks(spark):
    days = calendar.calendar(spark, "2024-01-04", "2024-01-09", [], [])
    moments = [(1, "2024-01-04", 0), (2, "2024-01-04", 680), (3, "2024-01-05", 899), (4, "2024-01-05", 1000), (5, "2024-01-06", 600), (6, "2024-01-09", 890), (7, "2023-12-31", 600)]
    m = spark.createDataFrame(moments, "id long, day string, minute long").withColumn("day", F.col("day").cast("date"))
    got = {r["id"]: (str(r["due_day"]), r["due_min"]) for r in calendar.advance(m, days, 60).collect()}
    assert got == {1: ("2024-01-04", 630), 2: ("2024-01-04", 830), 3: ("2024-01-08", 629), 4: ("2024-01-08", 630), 5: ("2024-01-08", 630)}
