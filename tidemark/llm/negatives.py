"""Hard negatives by exact search over one-dimensional distance keys.

Scores are inner products of integer vectors. One more component makes all
vectors equally long (sqrt(M^2 - |x|^2), M the longest; 0 for a query), so that
the largest product is the smallest distance: d^2 = |q|^2 + M^2 - 2 q.x. Every
vector belongs to its nearest pivot, and its key is its distance to it. The
index holds the vectors sorted by (pivot, key), in blocks of rows; the keys of a
pivot are cut into segments, whose least and greatest keys are known. By the triangle inequality
a vector of key t lies between |d(q, pivot) - t| and d(q, pivot) + t from a
query, so a segment bounds the scores in it from both sides.

A query scans the segments of the best bounds first, four times as many a
round. What is left of the keys lies in annuli around the pivots; once no
unscanned segment can hold a score that matters, the answer is certified.
Rounds are joins of (segment, queries) with the index's blocks. Positives are
searched first; the bands of allowed negative scores follow from them, and all
bands of a query are searched in one scan.

Vectors equal in all components and label are one class with its few smallest
ids, so that copies cost nothing. All comparisons that decide a result are on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import delete, written

PIVOTS, SEGMENTS = 16, 16
#: Classes that pivots and the cuts of keys are fitted to; every class is indexed.
SAMPLE = 4096
#: Rows of an index block, queries of a request, segments of the first round.
BLOCK, REQUEST, FIRST, GROWTH = 512, 128, 4, 4
SCALE = 256
#: Components of this size and beyond could give scores that a long can't hold.
LARGEST = 1 << 27
SALTS = 16
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def usable(table: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(id, label, vec): rows that take part, each component x as floor(256 x), as 32-bit integers in bytes.

    Out are rows of a null id, label or vector, of any null or non-finite component, or of one of 2^27 and more once scaled. Of rows of one id
    that of the smallest (label, vector) counts. A vector that is shorter than another has zeros beyond its end; an empty one scores 0.
    """
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * SCALE < LARGEST))
    rows = table.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled.alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, off = lists.flatten().to_numpy().astype("<i4"), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[s:e].tobytes() for s, e in zip(off, off[1:], strict=False)], pa.binary())], ["id", "label", "vec"])

    out = rows.mapInArrow(pack, "id long, label long, vec binary")
    if (rows.groupBy("id").count().agg(F.max("count")).first()[0] or 0) > 1:
        nth = F.row_number().over(Window.partitionBy("id").orderBy("label", "vec"))
        out = out.withColumn("nth", nth).where("nth = 1").drop("nth")
    return out


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(label, vec, first, ids): equal rows as one, with their `keep` smallest ids. All but those are left out before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
    return few.groupBy("label", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("label", "vec", F.col("ids")[0].alias("first"), "ids")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, "<i4")
        out[i, : len(row)] = row
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in doubles where no sum can leave their integers, else in longs."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * width
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < 1 << 53 else q @ x.T


def _lengthened(x: np.ndarray, width: int, longest: float) -> np.ndarray:
    """With the component that makes all equally long."""
    x = np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T, 0))


class Index:
    """The blocks' table, the pivots, and each segment's least and greatest key."""

    def __init__(self, classes: DataFrame, pivots: int = PIVOTS, segments: int = SEGMENTS, sample: int = SAMPLE, block: int = BLOCK) -> None:
        def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width, longest = 1, 0.0
            for batch in batches:
                for v in batch.column(0).to_pylist():
                    row = np.frombuffer(v, "<i4").astype(float)
                    width, longest = max(width, len(row)), max(longest, float(row @ row))
            yield pa.RecordBatch.from_arrays([pa.array([width]), pa.array([longest])], ["width", "longest"])

        top = classes.select("vec").mapInArrow(size, "width long, longest double").agg(F.max("width").alias("width"), F.max("longest").alias("longest")).first()
        self.width, self.longest = int(top["width"] or 1), float(top["longest"] or 0)
        some = matrix([bytes(r["vec"]) for r in classes.orderBy(F.xxhash64("first"), "first").limit(sample).select("vec").collect()], self.width)
        self._fit(_lengthened(some, self.width, self.longest), pivots, segments)
        self.per_pivot = segments
        self.blocks = self._written(classes, block)
        # At most pivots x segments rows.
        rows = self.blocks.groupBy("segment").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("segment").collect()
        self.segments = np.array([r["segment"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows], float) for c in ("low", "high"))

    def _fit(self, x: np.ndarray, pivots: int, segments: int) -> None:
        """Pivots by a few rounds of k-means on the sample, and the quantiles of each one's keys."""
        if not len(x):
            x = np.zeros((1, self.width + 1))
        centres = x[np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int)].copy()
        for _ in range(8):
            near = _distances(x, centres).argmin(axis=1)
            for p in range(len(centres)):
                if (near == p).any():
                    centres[p] = x[near == p].mean(axis=0)
        keys = _distances(x, centres)
        near = keys.argmin(axis=1)
        self.pivots = centres
        self.cuts = np.array([np.quantile(keys[near == p, p], np.arange(1, segments) / segments) if (near == p).any() else np.zeros(segments - 1) for p in range(len(centres))])

    def _written(self, classes: DataFrame, block: int) -> DataFrame:
        width, longest, pivots, cuts, per = self.width, self.longest, self.pivots, self.cuts, self.per_pivot

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                d = _distances(_lengthened(matrix(batch.column(1).to_pylist(), width), width, longest), pivots)
                near = d.argmin(axis=1)
                key = d[np.arange(len(d)), near]
                segment = near * per + (cuts[near] < key[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(segment), pa.array(key), *batch.columns], ["segment", "key", "label", "vec", "first", "ids"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def out(last: bool) -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(held).combine_chunks()
                segment = table.column("segment").to_numpy()
                at = 0
                while at < len(segment):
                    to = min(at + block, int(np.searchsorted(segment, segment[at], side="right")))
                    if to == len(segment) and to - at < block and not last:
                        break
                    rows = table.slice(at, to - at)
                    key, ids = rows.column("key").to_numpy(), rows.column("ids").to_pylist()
                    raw = [np.array(rows.column("label").to_numpy(), "<i8").tobytes(), matrix(rows.column("vec").to_pylist(), width).astype("<i4").tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(segment[at])]), pa.array([float(key[0])]), pa.array([float(key[-1])]), pa.array([raw[0]], pa.binary()), pa.array([raw[1]], pa.binary()), pa.array([ids], pa.list_(pa.list_(pa.int64())))],
                        ["segment", "low", "high", "labels", "vecs", "ids"],
                    )
                    at = to
                held[:] = table.slice(at).to_batches()

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    if sum(b.num_rows for b in held) >= 4 * block:
                        yield from out(False)
            if held:
                yield from out(True)

        rows = classes.select("label", "vec", "first", "ids").mapInArrow(keyed, "segment long, key double, label long, vec binary, first long, ids array<long>")
        rows = rows.repartitionByRange("segment", "key").sortWithinPartitions("segment", "key")
        return written(rows.mapInArrow(packed, "segment long, low double, high double, labels binary, vecs binary, ids array<array<long>>"), "negatives-index")


#: of: which of the query's targets; kth: the least score that still matters to each; seen: a bit a segment.
STATE = "qid long, label long, vec binary, low array<long>, high array<long>, kth array<long>, seen binary, next array<int>"


def _chosen(state: DataFrame, index: Index, count: int) -> DataFrame:
    """Each query's next segments: those that can hold a score that matters, not seen, of the best bounds."""
    width, longest, pivots = index.width, index.longest, index.pivots
    pivot, low, high = index.segments // index.per_pivot, index.low, index.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.pad(matrix(batch.column(2).to_pylist(), width), ((0, 0), (0, 1))).astype(float)
            d = _distances(q, pivots)[:, pivot]
            norm = (q**2).sum(axis=1)[:, None] + longest
            # Bounds of scores by the least and the greatest distance, and room for the rounding of doubles.
            room = 1e-9 * norm + 1
            best = (norm - np.maximum(np.maximum(d - high, low - d), 0) ** 2) / 2 + room
            worst = (norm - (d + high) ** 2) / 2 - room
            seen = np.unpackbits(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, : len(low)].astype(bool)
            nexts, marks = [], []
            for i, (lo, hi, kth) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                matters = np.zeros(len(low), bool)
                for a, b, k in zip(lo, hi, kth, strict=True):
                    matters |= (best[i] >= max(a, k)) & (worst[i] <= b)
                left = np.flatnonzero(matters & ~seen[i])
                order = left[np.argsort(-np.minimum(best[i][left], max(hi, default=0)), kind="stable")][:count]
                seen[i, order] = True
                nexts.append(order.astype(np.int32))
                marks.append(np.packbits(seen[i]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(6)), pa.array(marks, pa.binary()), pa.array(nexts, pa.list_(pa.int32()))], [x.split()[0] for x in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def _requests(chosen: DataFrame, index: Index, request: int) -> DataFrame:
    """(segment, queries): each segment's queries, some to a row. queries: an Arrow stream of (qid, label, vec, low, high, kth)."""
    segments = index.segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nexts = batch.column(6)
            at = nexts.flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), nexts.value_lengths().to_numpy())
            order = np.argsort(at, kind="stable")
            at, of = at[order], of[order]
            queries = batch.select(["qid", "label", "vec", "low", "high", "kth"])
            ends = np.append(np.flatnonzero(np.diff(at)) + 1, len(at))
            start = 0
            for end in ends:
                for s in range(start, end, request):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, queries.schema) as stream:
                        stream.write_batch(queries.take(pa.array(of[s : min(s + request, end)])))
                    yield pa.RecordBatch.from_arrays([pa.array([int(segments[at[s]])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["segment", "queries"])
                start = end

    return chosen.where(F.size("next") > 0).select("qid", "label", "vec", "low", "high", "kth", "next").mapInArrow(run, "segment long, queries binary")


def _scanned(pairs: DataFrame, same: bool, k: int, width: int) -> DataFrame:
    """(qid, target, score, first, ids): of each request and block the k best classes of each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw, labels, vecs, ids = (batch.column(c)[row] for c in range(4))
                q = pa.ipc.open_stream(raw.as_buffer()).read_all().combine_chunks()
                label = np.frombuffer(labels.as_buffer(), "<i8")
                score = products(matrix(q.column("vec").to_pylist(), width), np.frombuffer(vecs.as_buffer(), "<i4").reshape(len(label), -1).astype(np.int64))
                ids = ids.as_py()
                first = np.array([i[0] for i in ids], np.int64)
                alike = (q.column("label").to_numpy()[:, None] == label[None, :]) == same
                low, high, kth = (q.column(c).to_pylist() for c in ("low", "high", "kth"))
                qid, out = q.column("qid").to_numpy(), []
                for t in range(max(map(len, low))):
                    lo = np.array([max(a[t], b[t]) if t < len(a) else HIGHEST for a, b in zip(low, kth, strict=True)])
                    hi = np.array([a[t] if t < len(a) else LOWEST for a in high])
                    ok = alike & (score >= lo[:, None]) & (score <= hi[:, None])
                    if len(label) > k:
                        masked = np.where(ok, score, LOWEST)
                        ok &= score >= np.partition(masked, -k, axis=1)[:, -k][:, None]
                    i, j = np.nonzero(ok)
                    order = np.lexsort((first[j], -score[i, j], i))
                    i, j = i[order], j[order]
                    top = np.arange(len(i)) - np.searchsorted(i, i) < k
                    out.append((i[top], j[top], np.full(int(top.sum()), t)))
                i, j, t = (np.concatenate(x) for x in zip(*out, strict=True))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(t.astype(np.int32)), pa.array(score[i, j]), pa.array(first[j]), pa.array([ids[x] for x in j], pa.list_(pa.int64()))], ["qid", "target", "score", "first", "ids"])

    return pairs.mapInArrow(run, "qid long, target int, score long, first long, ids array<long>")


def search(queries: DataFrame, index: Index, same: bool, k: int, request: int = REQUEST, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(qid, target, score, first, ids): for each query (qid, label, vec, low, high) and each of its targets, scores from low to high, the k
    best classes of the same label, or of any other one; score first, ties by smallest id. Exact. Written.
    """
    blank = F.lit(bytes((len(index.segments) + 7) // 8))
    state = queries.select("qid", "label", "vec", "low", "high", F.col("low").alias("kth"), blank.alias("seen"), F.array().cast("array<int>").alias("next"))
    best = Window.partitionBy("qid", "target").orderBy(F.desc("score"), "first")
    hits, count, before = None, first, None
    # Every round sees segments that were not seen before, so there are at most as many rounds as it takes to see all.
    while True:
        chosen = written(_chosen(state, index, count), "negatives-state", before)
        if not chosen.where(F.size("next") > 0).limit(1).count():
            break
        # Requests are many times what they are made of, which Spark can't know: they are never to be broadcast.
        pairs = _requests(chosen, index, request).hint("merge").join(index.blocks, "segment").select("queries", "labels", "vecs", "ids")
        found = _scanned(pairs, same, k, index.width)
        found = (found if hits is None else hits.unionByName(found)).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")
        hits = written(found, "negatives-hits", hits)
        full = hits.groupBy("qid", "target").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        full = full.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("target", "score"))).alias("of"))
        kth = F.transform("kth", lambda x, i: F.coalesce(F.when(F.col("of").isNotNull(), F.element_at("of", i)), x))
        state = chosen.join(full, "qid", "left").select("qid", "label", "vec", "low", "high", kth.alias("kth"), "seen", "next")
        before, count = chosen, count * growth
    delete(chosen)
    return hits if hits is not None else queries.sparkSession.createDataFrame([], "qid long, target int, score long, first long, ids array<long>")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """(qid, target, rows): the k best rows of each target, as structs (minus, id), in order."""
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id")))
    return hits.select("qid", "target", each.alias("rows")).groupBy("qid", "target").agg(F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, k).alias("rows"))


def mined(table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", **index: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each anchor.

    anchors: a condition on `id`. Its positives are the first `positives` other rows of its label; to each belong the first `negatives` rows of other labels whose
    score is from 50 to 95 per cent of the positive's. Scores are integer products, larger first, ties by smaller id. See `usable` for
    rows that take no part. Positives of a negative score have no negatives, those of score 0 have the rows of score 0. An
    empty table, or one of a single label, gives no rows. Other columns are left out, whatever their names.
    """
    rows = written(usable(table, id_column, vector, label), "negatives-rows")
    classes = written(classes_of(rows, max(positives + 1, negatives)), "negatives-classes")
    found = Index(classes, **index)
    asked = classes_of(rows.where(anchors), 1).select(F.col("first").alias("qid"), "label", "vec")
    asked = written(asked, "negatives-queries")
    all_scores = lambda x: F.array(F.lit(x).cast("long"))
    near = written(_ranked(search(asked.withColumns({"low": all_scores(LOWEST), "high": all_scores(HIGHEST)}), found, True, positives + 1), positives + 1).select("qid", F.col("rows").alias("near")), "negatives-near")
    # 50 p <= 100 n <= 95 p, in integers that can't overflow.
    p = F.array_distinct(F.filter(F.transform("near", lambda x: -x["minus"]), lambda x: x >= 0))
    bands = asked.join(near, "qid").withColumn("p", p).where(F.size("p") > 0)
    bands = bands.withColumns({"low": F.expr("transform(p, x -> x - x div 2)"), "high": F.expr("transform(p, x -> x - (x + 19) div 20)")})
    hard = _ranked(search(bands.select("qid", "label", "vec", "low", "high"), found, False, negatives), negatives)
    hard = hard.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("target", F.col("rows").alias("hard")))).alias("hard"))
    answers = bands.join(hard, "qid").select("label", "vec", "near", "p", "hard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = rows.where(anchors).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(answers.hint("merge"), ["label", "vec", "salt"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, positives)
    each = each.select(F.col("id").alias("anchor_id"), F.explode(others).alias("positive"), "p", "hard")
    score = -F.col("positive.minus")
    each = each.where(score >= 0).select("anchor_id", F.col("positive.id").alias("positive_id"), score.alias("positive_score"), F.posexplode(F.element_at("hard", (F.array_position("p", score) - 1).cast("int"))).alias("nth", "negative"))
    return each.select("anchor_id", "positive_id", (F.col("nth") + 1).alias("rank"), F.col("negative.id").alias("negative_id"), "positive_score", (-F.col("negative.minus")).alias("negative_score"))
