"""Hard negatives against a plain search over all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, first string"
COLUMNS = "anchor_id positive_id rank negative_id positive_score negative_score".split()


def plain(rows, every):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        best[i] = min(best.get(i, (label, q)), (label, q), key=lambda r: (r[0], np.array(r[1], "<i4").tobytes()))
    out = []
    for a, (label, q) in best.items():
        if a % every:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(q, w, strict=False)), i, other) for i, (other, w) in best.items() if i != a))
        for p, i, _ in [s for s in scores if s[2] == label][:5]:
            fit = [(n, j) for n, j, other in scores if other != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every, **index):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mined(df, F.col("id") % every == 0, **index).collect())


def rows_of(seed, n=260, dim=6):
    rng = random.Random(seed)
    copy = [0.5, 0.25, -0.125, 0.0, 0.1, 0.3]
    rows = [(i, copy if rng.random() < 0.3 else [rng.choice([-1, 1]) * rng.choice([0.0, 0.01, 0.3, rng.random()]) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(1000, None, 1), (1005, [0.1] * dim, None), (None, [0.1] * dim, 1), (1010, [0.1, None, 0.2], 1), (1015, [float("nan")] * dim, 2), (1020, [float("inf")] * dim, 2)]
    rows += [(1025, [0.9, 0.9], 1), (1030, [], 1), (1035, [0.0] * dim, 2), (1040, [0.2] * 9, 3), (10, [0.7] * dim, 0), (15, copy, 9), (1045, [900.0] * dim, 1), (1050, [0.3] * dim, 77)]
    return rows


@pytest.mark.parametrize("seed,index", [(1, {}), (2, {"pivots": 3, "segments": 5, "sample": 20, "block": 7})])
def test_equals_plain(spark, seed, index):
    rows = rows_of(seed)
    want = plain(rows, 5)
    assert len(want) > 300
    assert mined(spark, rows, 5, **index) == want


def test_certified_before_all_is_seen(spark):
    """Vectors in clusters: bounds rule out most segments, and what is found is exact."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16)) * 2
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * 0.1).tolist(), (i // 12) % 3) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    usable = negatives.usable(df, "vec_id", "embedding", "label")
    index = negatives.Index(negatives.classes_of(usable, 6), segments=4)
    asked = negatives.classes_of(usable.where("id % 50 = 0"), 1).select(F.col("first").alias("qid"), "label", "vec")
    state = asked.withColumns({"low": F.array(F.lit(negatives.LOWEST)), "high": F.array(F.lit(negatives.HIGHEST)), "kth": F.array(F.lit(0).cast("long")), "seen": F.lit(bytes(8)), "next": F.array().cast("array<int>")})
    assert negatives._chosen(state, index, 4).where("size(next) <> 4").count() == 0
    kth = negatives.search(asked.withColumns({"low": F.array(F.lit(negatives.LOWEST)), "high": F.array(F.lit(negatives.HIGHEST))}), index, True, 6).groupBy("qid").agg(F.min("score").alias("s"))
    left = negatives._chosen(state.join(kth, "qid").withColumn("kth", F.array("s")).drop("s"), index, 1000)
    assert left.agg(F.avg(F.size("next"))).first()[0] < 0.5 * len(index.segments)
    assert mined(spark, rows, 50) == plain(rows, 50)


def test_large_components_are_exact():
    q, x = np.array([[1 << 26, -(1 << 26) + 1]]), np.array([[(1 << 26) - 1, 1 << 26], [3, 5]])
    assert negatives.products(q, x).tolist() == [[int(a) for a in (q.astype(object) @ x.T.astype(object))[0]]]


def test_empty_and_one_label(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [(i, [0.1 * i, 0.2], 1) for i in range(20)], 5) == []
