"""Walk-forward evaluation and models, with Spark ML where it has the model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import average_rank
from tidemark.sources import files


@dataclass(frozen=True)
class Fold:
    """Half-open day ranges of one walk-forward fold."""

    train: tuple[int, int]
    validation: tuple[int, int]
    test: tuple[int, int]


def walk_forward(first: int, train: int, validation: int, test: int, embargo: int, step: int, folds: int) -> list[Fold]:
    """Folds in time; `embargo` days lie between the parts, so that no label of one reaches the next."""
    out = []
    for k in range(folds):
        start = first + train + validation + 2 * embargo + k * max(step, test) + 2
        v1 = start - embargo
        t1 = v1 - validation - embargo
        out.append(Fold((t1 - train, t1), (v1 - validation, v1), (start, start + test)))
    return out


def assign(rows: DataFrame, folds: list[Fold], day: str) -> DataFrame:
    """Adds fold and part; a row stands in every fold that has its day, rows of the days between in none."""
    ranges = F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(part).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, f in enumerate(folds) for part, (a, b) in (("train", f.train), ("validation", f.validation), ("test", f.test))])
    held = F.filter(ranges, lambda r: (F.col(day) >= r["a"]) & (F.col(day) < r["b"]))
    return rows.withColumn("__f", F.explode(held)).withColumn("fold", F.col("__f.fold")).withColumn("part", F.col("__f.part")).drop("__f")


def quantiles(rows: DataFrame, column: str, shares: list[float], bins: int = 64) -> list[float | None]:
    """Exact quantiles, linear between neighbouring values, without all values in one place.

    Equal values are counted together, then dealt to bins of about equal size by
    approximate edges; only the bins that hold a wanted place are ordered, each in
    a task of its own. The driver sees one row a bin and two a quantile.
    """
    counts = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    edges = counts.approxQuantile("x", [k / bins for k in range(1, bins)], 0.25 / bins)
    if not edges:
        return [None] * len(shares)
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("x")))
    binned = counts.withColumn("bin", at)
    sizes = sorted(binned.groupBy("bin").agg(F.sum("n").alias("n")).collect())
    total = sum(r["n"] for r in sizes)
    before, base = {}, 0
    for r in sizes:
        before[r["bin"]] = base
        base += r["n"]
    wanted = sorted({int(f(p * (total - 1))) for p in shares for f in (np.floor, np.ceil)})
    home = {w: max(b for b in before if before[b] <= w) for w in wanted}
    offset = F.create_map(*[F.lit(v) for b in sorted(set(home.values())) for v in (b, before[b])])
    w = Window.partitionBy("bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ends = binned.where(F.col("bin").isin(sorted(set(home.values())))).withColumn("end", F.sum("n").over(w) + F.element_at(offset, F.col("bin")))
    places = F.array(*map(F.lit, wanted))
    hits = ends.select("x", F.filter(places, lambda p: (p < F.col("end")) & (p >= F.col("end") - F.col("n"))).alias("p")).where(F.size("p") > 0)
    value = {p: r["x"] for r in hits.collect() for p in r["p"]}
    out = []
    for p in shares:
        k = p * (total - 1)
        lo, hi = value[int(np.floor(k))], value[int(np.ceil(k))]
        out.append(lo + (hi - lo) * (k - np.floor(k)))
    return out


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z_<column>: missing values by the median, clipped to the first and last per cent, then by mean and population deviation; and
    missing_<column>, 1.0 where the value was null or not finite. A column without any value is 0 throughout."""
    unknown = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    marked = rows.select("*", *[unknown(c).alias(f"missing_{c}") for c in columns])
    q = {c: [x or 0.0 for x in quantiles(marked.where(~F.col(f"missing_{c}")), c, [0.01, 0.5, 0.99])] for c in columns}
    filled = lambda c: F.when(F.col(f"missing_{c}"), F.lit(q[c][1])).otherwise(F.least(F.greatest(c, F.lit(q[c][0])), F.lit(q[c][2])))
    w = marked.select("*", *[filled(c).alias(f"__w_{c}") for c in columns])
    m = w.agg(*[F.avg(f"__w_{c}").alias(f"__m_{c}") for c in columns], *[F.stddev_pop(f"__w_{c}").alias(f"__s_{c}") for c in columns])
    z = w.crossJoin(F.broadcast(m))
    scaled = [((F.col(f"__w_{c}") - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") < 1e-8, 1.0).otherwise(F.col(f"__s_{c}"))).alias(f"z_{c}") for c in columns]
    return z.select(*rows.columns, *scaled, *[F.col(f"missing_{c}").cast("double").alias(f"missing_{c}") for c in columns])


def daily_metrics(rows: DataFrame, day: str, id_column: str, p: str, value: str, y: str, k: int) -> DataFrame:
    """Of each day: rows, rank correlation of score and value (null where either doesn't vary), mean value and share of hits of the k first, Brier score,
    NDCG, and the share of all hits that is among the k first."""
    w = Window.partitionBy(day)
    r = rows.withColumn("rp", average_rank(F.col(p), day)).withColumn("rv", average_rank(F.col(value), day)).withColumn("place", F.row_number().over(w.orderBy(F.desc(p), id_column))).withColumn("ideal", F.row_number().over(w.orderBy(F.desc(y), id_column)))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col(y) / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    top = F.col("place") <= k
    hits = F.sum(F.when(top, F.col(y)))
    return r.groupBy(day).agg(
        F.count(F.lit(1)).alias("n"), (F.covar_pop("rp", "rv") / F.nullif(F.stddev_pop("rp") * F.stddev_pop("rv"), F.lit(0.0))).alias("rank_ic"), F.avg(F.when(top, F.col(value))).alias("top_mean"), (F.sum(F.when(top, F.col(y))).cast("double") / k).alias("top_rate"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.when(F.sum(y) > 0, gain("place") / gain("ideal")).alias("ndcg"), F.when(F.sum(y) > 0, hits.cast("double") / F.sum(y)).alias("recall")
    )


def held_out_metrics(rows: DataFrame, folds: list[Fold], scores: dict[str, str], day: str, id_column: str, value: str, y: str, k: int) -> DataFrame:
    """(variant, day, ...) of `daily_metrics` on the test days of the folds: a model's score and fixed baselines, each a column, on the same held-out rows.
    A missing score counts as 0. A day that is tested in several folds counts once."""
    held = assign(rows, folds, day).where("part = 'test'").drop("fold", "part").dropDuplicates([day, id_column])
    out = None
    for name, column in scores.items():
        own = held.withColumn("__score", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
        metrics = daily_metrics(own, day, id_column, "__score", value, y, k).select(F.lit(name).alias("variant"), day, "n", "rank_ic", "top_mean", "top_rate", "ndcg", "recall")
        out = metrics if out is None else out.unionByName(metrics)
    return out


def paired(daily: DataFrame, full: str, day: str, value: str, block: int = 3, samples: int = 500, seed: int = 7) -> DataFrame:
    """(variant, days, mean, low, high, p, q): how much better `full` is than each other variant on the days that both have, with an interval and a
    p-value by moving blocks; p-values are adjusted over the variants."""
    own = daily.where(F.col("variant") == full).select(day, F.col(value).alias("__full"))
    deltas = daily.where(F.col("variant") != full).join(own, day).withColumn("delta", F.col("__full") - F.col(value)).where("delta is not null")
    deltas = files.kept(deltas.select("variant", F.col(day).alias("order"), "delta"), "paired")
    days = deltas.groupBy("variant").agg(F.count(F.lit(1)).alias("days"))
    return bh_adjust(block_bootstrap(deltas, "variant", "order", "delta", block, samples, seed), "variant", "p").join(days, "variant").select("variant", "days", "mean", "low", "high", "p", "q")


def psi(rows: DataFrame, x: str, train: str) -> DataFrame:
    """Population stability: decile bins of the train half, half a row added to each count."""
    edges = quantiles(rows.where(F.col(train)), x, [k / 10 for k in range(1, 10)])
    binned = rows.withColumn("bin", F.size(F.filter(F.array(*[F.lit(e).cast("double") for e in edges]), lambda e: e < F.col(x))))
    c = binned.groupBy("bin").agg((F.count_if(F.col(train)) + 0.5).alias("a"), (F.count_if(~F.col(train)) + 0.5).alias("b"))
    s = c.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    part = (F.col("a") / F.col("sa") - F.col("b") / F.col("sb")) * F.log((F.col("a") / F.col("sa")) / (F.col("b") / F.col("sb")))
    return c.crossJoin(F.broadcast(s)).agg(F.sum(part).alias("psi"), F.count(F.lit(1)).alias("bins"))


def bh_adjust(rows: DataFrame, test: str, p: str, bins: int = 64) -> DataFrame:
    """Adds q, the step-up adjusted p-value: the smallest p n / rank from the row's place up. Null p-values count nowhere and have none.

    Equal p-values are counted together: all of them have the rank of the last, as the smallest of their values is what counts. Distinct ones are
    dealt to bins by approximate edges and ordered within them; what lies after a bin is a table of one row a bin.
    """
    counts = rows.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("same"))
    edges = F.array(*map(F.lit, sorted(set(counts.approxQuantile(p, [k / bins for k in range(1, bins)], 0.25 / bins))))).cast("array<double>")
    binned = counts.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col(p))))
    # One row a bin from here on.
    sizes = binned.groupBy("bin").agg(F.sum("same").alias("n"))
    places = sizes.select("bin", (F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.sum("same").over(Window.partitionBy("bin").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    valued = binned.join(F.broadcast(places), "bin").withColumn("v", F.col(p) * F.col("total") / rank)
    later = valued.groupBy("bin").agg(F.min("v").alias("low")).select("bin", F.min("low").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    low = F.min("v").over(Window.partitionBy("bin").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    # F.least passes over nulls: the last bin has nothing after it.
    adjusted = valued.join(F.broadcast(later), "bin").select(p, F.least(F.lit(1.0), low, "later").alias("q"))
    return rows.join(adjusted, p, "left").select(*rows.columns, "q")


def residuals(rows: DataFrame, schema: str, keys: list[str], id_column: str, y: str, controls: list[str], group: str, ridge: float) -> DataFrame:
    """Cross-sectional ridge residuals with group dummies, the first dropped. Too few rows give none."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        dummies = pd.get_dummies(pdf[group]).to_numpy(float)[:, 1:]
        x = np.column_stack([np.ones(len(pdf)), pdf[controls].to_numpy(float), dummies])
        out = pdf[[*keys, id_column]].copy()
        if len(pdf) <= len(controls) + 2:
            out["residual"] = None
            return out.iloc[:0]
        b = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ pdf[y].to_numpy(float))
        out["residual"] = pdf[y].to_numpy(float) - x @ b
        return out

    return rows.dropna(subset=[y, *controls]).groupBy(*keys).applyInPandas(solve, f"{schema}, residual double")


def block_bootstrap(rows: DataFrame, key: str, order: str, value: str, block: int, samples: int, seed: int) -> DataFrame:
    """(key, mean, low, high, p): moving blocks; p from the means centred on zero. A key's rows are its days, so a group is small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        rng = np.random.default_rng(seed)
        n = len(v)
        starts = rng.integers(0, max(n - block + 1, 1), (samples, -(-n // block)))
        at = (starts[:, :, None] + np.arange(block)).reshape(samples, -1)[:, :n] % n
        means = v[at].mean(axis=1)
        p = (np.sum(np.abs(means - v.mean()) >= abs(v.mean())) + 1) / (samples + 1)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [v.mean()], "low": [np.quantile(means, 0.025)], "high": [np.quantile(means, 0.975)], "p": [float(p)]})

    return rows.groupBy(key).applyInPandas(run, f"{key} string, mean double, low double, high double, p double")


def by_day(rows: DataFrame, day: str, name: str) -> DataFrame:
    """Adds a weight by which each day counts alike, however many rows it has; weights are 1 on average."""
    days = rows.groupBy(day).agg(F.count(F.lit(1)).alias("__n"))
    size = days.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("d")).first()
    return rows.join(days, day).withColumn(name, F.lit(float(size["n"] or 0)) / (F.col("__n") * F.lit(float(max(size["d"], 1))))).drop("__n")


def _vectors(rows: DataFrame, features: list[str], y: str, weight: str | None = None) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    z = standardised(rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias("label"), own.alias("__weight")), features)
    return VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="features").transform(z).select("features", "label", F.col("__weight").alias("weight"))


def _coefficients(spark: SparkSession, features: list[str], coef, intercept: float) -> DataFrame:
    return spark.createDataFrame([*[(f, float(c)) for f, c in zip(features, coef, strict=True)], ("intercept", float(intercept))], "feature string, coefficient double")


def ridge(spark: SparkSession, rows: DataFrame, features: list[str], y: str, alpha: float, weight: str | None = None) -> DataFrame:
    """Ridge by the normal equations, rows weighted by a column (`by_day`). Spark scales the label, so the penalty is alpha times its deviation over the
    sum of weights."""
    from pyspark.ml.regression import LinearRegression

    x = _vectors(rows, features, y, weight)
    s = x.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("s1"), F.sum(F.col("weight") * F.col("label") * F.col("label")).alias("s2")).first()
    n = s["n"] or 1.0
    deviation = max((s["s2"] or 0.0) / n - ((s["s1"] or 0.0) / n) ** 2, 0.0) ** 0.5
    m = LinearRegression(elasticNetParam=0.0, standardization=False, regParam=alpha * deviation / n, solver="normal", weightCol="weight").fit(x)
    return _coefficients(spark, features, m.coefficients, m.intercept)


def logistic_fit(spark: SparkSession, rows: DataFrame, features: list[str], y: str, c: float, weight: str | None = None) -> DataFrame:
    """Logistic coefficients of inverse penalty c, rows weighted by a column (`by_day`)."""
    from pyspark.ml.classification import LogisticRegression

    x = _vectors(rows, features, y, weight)
    total = x.agg(F.sum("weight")).first()[0] or 1.0
    m = LogisticRegression(elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * total), maxIter=50, weightCol="weight").fit(x)
    return _coefficients(spark, features, m.coefficients, m.intercept)


def isotonic(spark: SparkSession, rows: DataFrame, p: str, y: str) -> DataFrame:
    from pyspark.ml.regression import IsotonicRegression

    m = IsotonicRegression(featuresCol="features").fit(rows.select(F.col(p).alias("features"), F.col(y).cast("double").alias("label")))
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(m.boundaries, m.predictions, strict=True)], "boundary double, value double")


#: Rows of a day, from its top, whose pairs with all of its rows count; and how many of them are compared at a time.
TRUNCATION, BLOCK = 1000, 64


def _lambdas(score: np.ndarray, grade: np.ndarray, most: int = TRUNCATION, block: int = BLOCK) -> np.ndarray:
    """Each row's pull: over the pairs of unlike grades of which one is among the `most` first the chance that the pair is in the wrong order, times
    what swapping them would change of the NDCG. Pairs further down change it by next to nothing. Memory is `block` times the rows, time `most` times.
    """
    n = len(score)
    order = np.lexsort((np.arange(n), -score))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    discount = 1 / np.log2(place + 2.0)
    gain = 2.0**grade - 1
    ideal = float((np.sort(gain)[::-1] / np.log2(np.arange(n) + 2.0)).sum())
    pull = np.zeros(n)
    if ideal <= 0:
        return pull
    for s in range(0, min(most, n), block):
        top = order[s : min(s + block, most, n)]
        # Each pair once: with the rows below the first of the two.
        later = place[None, :] > place[top][:, None]
        sign = np.sign(grade[top][:, None] - grade[None, :]) * later
        wrong = 1 / (1 + np.exp(np.clip(sign * (score[top][:, None] - score[None, :]), -35, 35)))
        by = sign * wrong * np.abs((gain[top][:, None] - gain[None, :]) * (discount[top][:, None] - discount[None, :])) / ideal
        pull[top] += by.sum(axis=1)
        pull -= by.sum(axis=0)
    return pull


def pairwise_ranker(rows: DataFrame, features: list[str], grade: str, day: str, id_column: str, split: int, keep: Callable[[DataFrame], DataFrame], trees: int = 8, depth: int = 3, rate: float = 0.3) -> DataFrame:
    """(day, id, grade, score): trees boosted on a pairwise objective, fitted before the split day and scored everywhere.

    In each round every day's cross-section gives its rows their pulls, and a tree
    is fitted to them, by Spark's histograms of splits; each day weighs the same. A
    cross-section is held by one task, with a few numbers a row (see `_lambdas`); `keep` writes a round's scores so that plans stay short.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    flat = rows.select(F.col(day).cast("long").alias("day"), F.col(id_column).cast("long").alias("id"), F.col(grade).cast("double").alias("grade"), *[F.col(f).cast("double").alias(f) for f in features])
    scored = keep(flat.withColumn("score", F.lit(0.0)))
    vectors = VectorAssembler(inputCols=features, outputCol="features")
    tree = DecisionTreeRegressor(labelCol="pull", weightCol="weight", maxDepth=depth, seed=7)

    def pulls(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(pull=_lambdas(pdf["score"].to_numpy(float), pdf["grade"].to_numpy(float)))

    schema = "day long, id long, grade double, " + ", ".join(f"{f} double" for f in features) + ", score double, pull double"
    for _ in range(trees):
        pulled = keep(scored.where(F.col("day") < split).groupBy("day").applyInPandas(pulls, schema))
        pulled = vectors.transform(pulled)
        model = tree.fit(by_day(pulled.select("day", "features", "pull"), "day", "weight"))
        scored = keep(model.transform(vectors.transform(scored)).select(*scored.columns[:-1], (F.col("score") + rate * F.col("prediction")).alias("score")))
    return scored.select("day", "id", "grade", "score")


def experiment(
    spark: SparkSession, rows: DataFrame, folds: list[Fold], variants: dict[str, list[str]], y: str, day: str, grid: tuple[float, ...], block: int = 3, samples: int = 500, seed: int = 7
) -> DataFrame:
    """One row a variant: (variant, chosen, days, brier, baseline_brier, mean, low, high, p, q).

    In each fold a logistic model of the variant's features is fitted for every
    penalty of the grid; the one of the best validation Brier score is measured on
    the test days, against the training part's base rate. Daily differences over all
    folds give an interval and a p-value by moving blocks; p-values are adjusted over
    the variants. The driver holds the grid and the choices; rows stay in Spark.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    parts = files.kept(assign(rows.withColumn("label", F.col(y).cast("double")), folds, day), "experiment")
    measured, chosen = None, {v: [] for v in variants}
    p = vector_to_array("probability")[1]
    for k in range(len(folds)):
        own = parts.where(F.col("fold") == k)
        base = own.where("part = 'train'").agg(F.avg("label"), F.count(F.lit(1))).first()
        rate, n = base[0] or 0.0, max(base[1], 1)
        for name, features in variants.items():
            raw = VectorAssembler(inputCols=features, outputCol="raw").transform(own)
            x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw.where("part = 'train'")).transform(raw).select("part", "features", "label", F.col(day).cast("long").alias("day"))
            train, best = x.where("part = 'train'"), None
            for c in grid:
                m = LogisticRegression(elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * n), maxIter=30).fit(train)
                loss = m.transform(x.where("part = 'validation'")).agg(F.avg((p - F.col("label")) * (p - F.col("label")))).first()[0]
                if loss is not None and (best is None or loss < best[0]):
                    best = (loss, c, m)
            if best is None:
                continue
            chosen[name].append(f"{best[1]:g}")
            loss, flat = (p - F.col("label")) * (p - F.col("label")), (F.lit(float(rate)) - F.col("label")) * (F.lit(float(rate)) - F.col("label"))
            daily = best[2].transform(x.where("part = 'test'")).groupBy("day").agg(F.avg(loss).alias("brier"), F.avg(flat).alias("base")).select(F.lit(name).alias("variant"), F.lit(k).alias("fold"), "day", "brier", "base")
            measured = daily if measured is None else measured.unionByName(daily)
    if measured is None:
        return spark.createDataFrame([], "variant string, chosen string, days long, brier double, baseline_brier double, mean double, low double, high double, p double, q double")
    measured = measured.withColumn("delta", F.col("brier") - F.col("base")).withColumn("order", F.col("fold") * 100_000 + F.col("day"))
    measured = files.kept(measured, "experiment")
    means = measured.groupBy("variant").agg(F.count(F.lit(1)).alias("days"), F.avg("brier").alias("brier"), F.avg("base").alias("baseline_brier"))
    intervals = bh_adjust(block_bootstrap(measured, "variant", "order", "delta", block, samples, seed), "variant", "p")
    choices = spark.createDataFrame([(v, ",".join(c)) for v, c in chosen.items()], "variant string, chosen string")
    return means.join(intervals, "variant").join(choices, "variant").select("variant", "chosen", "days", "brier", "baseline_brier", "mean", "low", "high", "p", "q")
