"""Quality classifier: Bradley-Terry ranking learnt from preference pairs.

Each document gets a few dozen numbers from its whole text (shares of character
classes, word shapes, repetition). Of the labelled training rows, a good and a
bad document make a preference pair; the chance that the first wins is the
logistic function of the difference of their strengths, and a strength is linear
in the features, so the fit is logistic loss on feature differences.

Strengths become scores by a quantile threshold: the strength below which the
training sample's share of bad documents lies is mapped to a score of `CUT`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import NOT_SPACE, flat, slices, word_hashes, words

#: Labelled rows that a fit takes at most: those of the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000
#: Preference pairs that each row of the rarer class takes part in.
PAIRS_PER_ROW = 8
CUT = 0.3
L2 = 1e-3
FAR = 8.0

#: Character classes by byte: 0 lower, 1 upper, 2 beyond ASCII, 3 digit, 4 blank, 5 line feed, 6 stop, 7 comma, 8 exclamation, 9 symbols, 10 bar, 11 other.
_CLASSES = np.full(256, 11, np.int64)
_CLASSES[0x61:0x7B], _CLASSES[0x41:0x5B], _CLASSES[0x80:], _CLASSES[0x30:0x3A], _CLASSES[0x20], _CLASSES[0x0A] = 0, 1, 2, 3, 4, 5
for _chars, _k in ((b".", 6), (b",", 7), (b"!?", 8), (b"#$%&*@^~+=<>/\\_", 9), (b"|", 10)):
    _CLASSES[list(_chars)] = _k
N_CLASSES = 12


def features_of(text: pa.Array) -> np.ndarray:
    """One row of numbers a text; an empty text has zeros but for the constant share of distinct words."""
    body, off = flat(text)
    n, size = len(text), np.diff(off)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * N_CLASSES + _CLASSES[body], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64)
    share = counts / np.maximum(size, 1)[:, None]
    starts, ends, first = words(body, off, NOT_SPACE)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    h = word_hashes(body, starts, ends, lower=True)
    some = np.maximum(n_words, 1)
    mean = lambda x: np.bincount(doc, weights=x, minlength=n) / some
    same = np.zeros(len(h))
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h))
    if len(h) > 1:
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    length = (ends - starts).astype(np.float64)
    caps = _CLASSES[body[starts]] == 1 if len(starts) else np.zeros(0)
    tail = _CLASSES[body[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    columns = [
        np.log1p(size),
        *np.sqrt(share[:, [1, 3, 5, 6, 7, 8, 9, 10, 11]]).T,
        *share[:, [0, 1, 2, 4, 6, 8, 9, 10]].T,
        mean(length),
        np.sqrt(mean((length > 14).astype(float))),
        mean(same),
        np.sqrt(mean(same)),
        np.bincount(doc[order], weights=fresh, minlength=n) / some if len(h) else np.zeros(n),
        mean(caps.astype(float)),
        mean(np.isin(tail, (8, 9, 10)).astype(float)),
        mean((length == 1).astype(float)),
    ]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Ranker:
    """Weights of the standardised features, and the strength that the quantile threshold stands at, with the spread of strengths."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float
    spread: float

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        """Strengths of rows of features: linear in the standardised features, which count no further than `FAR` deviations out."""
        return np.clip((rows - np.array(self.mean)) / np.array(self.scale), -FAR, FAR) @ np.array(self.weights)

    def scores_of(self, rows: np.ndarray) -> np.ndarray:
        """The score between 0 and 1: the logistic function of the strength's distance from the threshold, which scores CUT."""
        return 1 / (1 + np.exp(-np.clip((self.strengths(rows) - self.threshold) / self.spread + np.log(CUT / (1 - CUT)), -700, 700)))


def fit_ranker(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Ranker:
    """Fits the strengths on a bounded sample: logistic loss on differences of good and bad rows, by Newton's steps."""
    mean, scale = x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    z = np.clip((x - mean) / scale, -FAR, FAR) if len(x) else x
    best, worst = z[good], z[~good]
    if not len(best) or not len(worst):
        return Ranker(mean.tolist(), scale.tolist(), [0.0] * x.shape[1], -1.0, 1.0)
    rng = np.random.default_rng(seed)
    few = min(len(best), len(worst))
    many = max(len(best), len(worst), few * PAIRS_PER_ROW)
    pick = lambda n: np.concatenate([rng.permutation(n) for _ in range(-(-many // n))])[:many]
    d = best[pick(len(best))] - worst[pick(len(worst))]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
        gradient = d.T @ (1 - p) / len(d) - L2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + L2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    threshold = float(np.quantile(s, 1 - good.mean()))
    return Ranker(mean.tolist(), scale.tolist(), w.tolist(), threshold, float(max(s.std() / 4, 1e-9)))


def held_out(column: str = "doc_id") -> Column:
    """True for rows that no fit may see: crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y): at most `most` labelled ids outside the held-out fold, those of the smallest hash. Null labels and ids are left out; of repeated labels the largest counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return own.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAINING_ROWS) -> Ranker:
    """Fits on the sampled rows that `docs` holds. The sample's bound is a parameter, so it is broadcast to find their texts; of rows of one id the smallest text counts."""
    sample = F.broadcast(training_sample(labels, label, most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = features_of(batch.column(1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), values], ["doc_id", "y", "features"])

    rows = texts.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, features array<double>").groupBy("doc_id").agg(F.min("features").alias("features"), F.max("y").alias("y")).orderBy("doc_id").collect()
    x = np.array([r["features"] for r in rows], float) if rows else np.zeros((0, features_of(pa.array([""])).shape[1]))
    return fit_ranker(x, np.array([r["y"] == 1 for r in rows], bool))


def scores(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 if score >= 0.3).

    Null and empty texts are scored like any other; repeated rows give a row each
    and get equal scores, as do equal texts; a null doc_id is scored but trains
    nothing; without labels of both kinds all score above the cut; an empty table
    gives none; a text of any length is read whole, in one task; other columns
    are left out, whatever their names.
    """
    ranker = train(docs, labels, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.scores_of(features_of(batch.column(1))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The documents that score CUT or more, by the same model as `scores`, with all their columns, whatever their names.

    Null and empty texts are scored like any other, repeated rows fare alike, and an empty table gives none.
    """
    ranker = train(docs, labels, most=most)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(ranker.scores_of(features_of(batch.column(at))) >= CUT))

    return docs.mapInArrow(run, docs.schema)
