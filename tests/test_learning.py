"""Models and their measures against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import learn

QUERIES = registry.queries()


def ndcg(score, grade):
    gain = 2.0 ** np.asarray(grade) - 1
    order = np.argsort(-np.asarray(score), kind="stable")
    discount = 1 / np.log2(np.arange(len(gain)) + 2.0)
    return (gain[order] * discount).sum() / (np.sort(gain)[::-1] * discount).sum()


def test_lambdas_point_up_the_ndcg():
    score, grade = np.array([0.3, 0.1, 0.2, 0.0]), np.array([0.0, 2.0, 1.0, 1.0])
    pull = learn._lambdas(score, grade)
    want = np.zeros(4)
    place = {0: 0, 2: 1, 1: 2, 3: 3}
    ideal = sum((2.0**g - 1) / np.log2(k + 2) for k, g in enumerate(sorted(grade, reverse=True)))
    for i in range(4):
        for j in range(4):
            if grade[i] > grade[j]:
                swap = abs((2.0 ** grade[i] - 2.0 ** grade[j]) * (1 / np.log2(place[i] + 2) - 1 / np.log2(place[j] + 2))) / ideal
                by = swap / (1 + np.exp(score[i] - score[j]))
                want[i] += by
                want[j] -= by
    assert pull == pytest.approx(want)
    assert ndcg(score + pull, grade) > ndcg(score, grade)
    assert learn._lambdas(score, np.zeros(4)).tolist() == [0, 0, 0, 0]


def test_lambdas_in_blocks_and_of_the_top(spark):
    rng = np.random.default_rng(2)
    score, grade = rng.normal(size=300).round(1), rng.integers(0, 5, 300).astype(float)
    whole = learn._lambdas(score, grade, 300, 300)
    assert learn._lambdas(score, grade, 1000, 7) == pytest.approx(whole)
    few = learn._lambdas(score, grade, 20, 8)
    assert few.sum() == pytest.approx(0) and not few == pytest.approx(whole)
    large = rng.normal(size=200_000)
    assert abs(learn._lambdas(large, (large > 1).astype(float), 200).sum()) < 1e-6


def test_weights_and_missing_values(spark):
    rng = np.random.default_rng(3)
    rows = [(int(day), None if rng.random() < 0.2 else float(x), float(x * (1 if day else -1) + rng.normal() * 0.1)) for day in range(2) for x in rng.normal(size=20 + 300 * day)]
    df = learn.by_day(spark.createDataFrame(rows, "day int, a double, y double"), "day", "w")
    assert df.agg(F.sum("w")).first()[0] == pytest.approx(len(rows))
    assert {r[0] for r in df.groupBy("day").agg(F.round(F.sum("w"), 6)).select("round(sum(w), 6)").collect()} == {len(rows) / 2}
    z = learn.standardised(df, ["a"]).toPandas()
    values = np.array([r[1] for r in rows if r[1] is not None])
    assert z["missing_a"].sum() == len(rows) - len(values)
    low, mid, high = np.quantile(values, [0.01, 0.5, 0.99])
    filled = np.where(z["a"].isna(), mid, np.clip(z["a"].fillna(0), low, high))
    assert z["z_a"].to_numpy() == pytest.approx((filled - filled.mean()) / filled.std())
    x, w, y = np.column_stack([z["z_a"], np.ones(len(z))]), z["w"].to_numpy(), z["y"].to_numpy()
    want = np.linalg.solve(x.T @ (w[:, None] * x) + np.diag([1.0, 0]), x.T @ (w * y))
    got = {r["feature"]: r["coefficient"] for r in learn.ridge(spark, df, ["a"], "y", 1.0, "w").collect()}
    assert (got["a"], got["intercept"]) == pytest.approx(tuple(want), rel=1e-3, abs=1e-4)


def test_pairwise_ranker(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 30, 2))
    grade = np.argsort(np.argsort(x[:, :, 0] ** 2 + 0.1 * rng.normal(size=(12, 30)), axis=1), axis=1) // 6
    data = [(day, k, float(x[day, k, 0]), float(x[day, k, 1]), int(grade[day, k])) for day in range(12) for k in range(30)]
    df = spark.createDataFrame(data, "day int, id int, a double, b double, grade int")
    out = learn.pairwise_ranker(df, ["a", "b"], "grade", "day", "id", split=9, keep=lambda d: spark.createDataFrame(d.collect(), d.schema), trees=6).toPandas()
    held = [ndcg(g["score"], g["grade"]) for _, g in out[out.day >= 9].groupby("day")]
    plain = [ndcg(np.zeros(len(g)), g["grade"]) for _, g in out[out.day >= 9].groupby("day")]
    assert np.mean(held) > 0.9 > np.mean(plain)


def test_experiment(spark):
    rng = np.random.default_rng(1)
    rows = []
    for day in range(60):
        for k in range(40):
            a, b = rng.normal(size=2)
            rows.append((day, k, float(a), float(b), int(rng.random() < 1 / (1 + np.exp(-2 * a)))))
    df = spark.createDataFrame(rows, "day int, id int, a double, b double, y int")
    folds = learn.walk_forward(0, train=20, validation=6, test=8, embargo=1, step=8, folds=2)
    out = {r["variant"]: r for r in learn.experiment(spark, df, folds, {"both": ["a", "b"], "noise": ["b"]}, "y", "day", grid=(0.1, 10.0), samples=200).collect()}
    assert out["both"]["days"] == out["noise"]["days"] == 16
    y, days = np.array([r[4] for r in rows]), np.array([r[0] for r in rows])
    base = [np.mean((y[(days >= f.train[0]) & (days < f.train[1])].mean() - y[days == d]) ** 2) for f in folds for d in range(*f.test)]
    assert out["both"]["baseline_brier"] == pytest.approx(np.mean(base))
    assert out["both"]["mean"] == pytest.approx(out["both"]["brier"] - out["both"]["baseline_brier"])
    assert out["both"]["high"] < -0.03 and out["both"]["q"] < 0.05 and abs(out["noise"]["mean"]) < 0.01
    assert all(r["low"] <= r["mean"] <= r["high"] and r["p"] <= r["q"] <= 1 for r in out.values())
    assert all(len(r["chosen"].split(",")) == 2 for r in out.values())


def test_residuals_are_those_of_ridge(spark):
    rng = np.random.default_rng(2)
    rows = [("m", k, float(rng.normal()), float(rng.normal()), "ab"[k % 2]) for k in range(30)] + [("few", 99, 1.0, 1.0, "a")]
    df = spark.createDataFrame([(m, k, 2 * x + z * (g == "b") + 0.01 * k, x, g) for m, k, x, z, g in rows], "m string, id long, y double, x double, g string")
    got = {r["id"]: r["residual"] for r in learn.residuals(df, "m string, id long", ["m"], "id", "y", ["x"], "g", 1e-6).collect()}
    y = np.array([2 * x + z * (g == "b") + 0.01 * k for m, k, x, z, g in rows[:30]])
    a = np.column_stack([np.ones(30), [r[2] for r in rows[:30]], [float(r[4] == "b") for r in rows[:30]]])
    b = np.linalg.solve(a.T @ a + 1e-6 * np.eye(3), a.T @ y)
    assert [got[k] for k in range(30)] == pytest.approx(list(y - a @ b)) and 99 not in got


def test_logistic_meets_its_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0])))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, y double")
    got = {r["feature"]: r["coefficient"] for r in learn.logistic_fit(spark, df, ["a", "b"], "y", 1.0).collect()}
    w = np.clip(x, np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0))
    z = (w - w.mean(0)) / w.std(0)
    coef = np.array([got["a"], got["b"]])
    p = 1 / (1 + np.exp(-(z @ coef + got["intercept"])))
    assert np.abs(z.T @ (p - y) + coef).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_bootstrap_and_isotonic(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0.5, 1.0, 200)
    df = spark.createDataFrame([("v", k, float(x)) for k, x in enumerate(v)], "variant string, day int, delta double")
    r = learn.block_bootstrap(df, "variant", "day", "delta", 3, 500, 7).first()
    half = 1.96 * v.std() / np.sqrt(200)
    assert r["mean"] == pytest.approx(v.mean()) and r["low"] == pytest.approx(v.mean() - half, abs=0.08) and r["high"] == pytest.approx(v.mean() + half, abs=0.08) and r["p"] < 0.01
    points = [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.5, 1)]
    out = learn.isotonic(spark, spark.createDataFrame(points, "p double, y int"), "p", "y").orderBy("boundary").collect()
    assert [(round(r["boundary"], 3), r["value"]) for r in out] == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.4, 1.0), (0.5, 1.0)]


def test_fixture_queries(spark, data):
    ranked = QUERIES["fit_ranker"](spark, data).toPandas()
    assert ranked.groupby("day")["grade"].nunique().max() == 5 and ranked["score"].nunique() > 3
    out = QUERIES["experiment"](spark, data).collect()
    assert {r["variant"] for r in out} == {"full", "without_f1", "without_f2", "f1_only"} and all(0 <= r["q"] <= 1 for r in out)
    residuals = QUERIES["style_residual"](spark, data).toPandas()
    assert residuals.groupby("month")["residual"].mean().abs().max() < 1e-3
    ridge = {r["feature"]: r["coefficient"] for r in QUERIES["fit_ridge"](spark, data).collect()}
    logistic = {r["feature"]: r["coefficient"] for r in QUERIES["fit_logistic"](spark, data).collect()}
    assert set(ridge) == set(logistic) == {"f1", "f2", "f3", "intercept"} and ridge["f1"] < 0 > logistic["f1"]
    assert QUERIES["html_text"](spark, data).where(F.col("text").rlike("<[a-z]+>")).count() == 0


def test_baselines_on_the_same_days(spark):
    rng = np.random.default_rng(4)
    rows = [(day, i, float(x), 1.0, float(x + 0.2 * rng.normal()), int(x > 0.5)) for day in range(40) for i, x in enumerate(rng.normal(size=30))]
    df = spark.createDataFrame(rows, "day int, id int, good double, flat double, value double, y int").withColumn("none", F.when(F.col("day") < 0, F.lit(1.0)))
    folds = learn.walk_forward(0, train=10, validation=4, test=6, embargo=1, step=3, folds=2)
    daily = learn.held_out_metrics(df, folds, {"good": "good", "flat": "flat", "none": "none"}, "day", "id", "value", "y", 5).toPandas()
    days = sorted({d for f in folds for d in range(*f.test) if d < 40})
    assert sorted(daily[daily.variant == "good"]["day"]) == days and len(daily) == 3 * len(days)
    assert (daily[daily.variant == "good"]["rank_ic"].astype(float) > 0.8).all() and daily[daily.variant != "good"]["rank_ic"].isna().all()
    out = {r["variant"]: r for r in learn.paired(spark.createDataFrame(daily), "good", "day", "top_mean", samples=200).collect()}
    assert set(out) == {"flat", "none"}
    by = daily.pivot(index="day", columns="variant", values="top_mean").astype(float)
    for v, r in out.items():
        assert r["days"] == len(days) and r["mean"] == pytest.approx((by["good"] - by[v]).mean()) and r["low"] > 0 and r["q"] < 0.05
