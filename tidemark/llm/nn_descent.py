"""Approximate nearest neighbours by NN-descent and greedy graph search, by cosine.

Equal vectors are one node, with the few smallest ids of theirs that an answer
can need. A first graph comes from random projections: nodes are sorted by a
code of hyperplane signs and compared within blocks of equal size, so dense
regions make more blocks, not larger ones. Then rounds of NN-descent: each
node's neighbours, forward and reverse, are joined to it with their vectors and
compared with each other; a pair enters the graph where it beats a neighbour
that its ends have. Only pairs with a neighbour new since the last round are
compared, and rounds end when few are new.

A query walks the graph: of the best nodes found so far those not yet expanded
are joined to their neighbours, until none of the best is unexpanded. Its
answers are scored anew on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repeats import whole_groups
from .store import delete, written

#: Neighbours a node keeps, reverse neighbours that a round takes in, blocks and projections of the first graph.
NEIGHBOURS, REVERSE = 20, 16
BLOCK, TREES, PLANES = 1500, 8, 8
LEAST_NEW = 0.05
#: Of a search: nodes kept as best, expanded a round.
POOL, EXPANDED = 240, 60
#: Rounds end by their own tests; one that comes to these has gone wrong and is an error, not a shorter answer.
ROUNDS_BOUND, SEARCH_BOUND = 200, 2000


def _vectors(column: pa.Array) -> np.ndarray:
    rows = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    return np.frombuffer(b"".join(rows.to_pylist()), np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.float32)


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v): rows whose vector has a direction: not null, no null or non-finite component, not zero, of the table's commonest length.

    Of rows of one id the smallest vector counts. Vectors of different lengths have no cosine: those of the length that most
    rows have take part (of equally common lengths the largest).
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    top = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("v") == (top["size"] if top else 0))


def nodes_of(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(node, vec) of distinct vectors, unit length, 32-bit floats; and (node, id) of the `keep` smallest ids of each. node: its smallest id."""
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
    each = salted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))
    each = written(each.withColumn("node", F.element_at("ids", 1)), "ann-classes")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            m = m / np.abs(m).max(axis=1, keepdims=True)
            m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in m], pa.binary())], ["node", "vec"])

    return written(each.select("node", "v").mapInArrow(unit, "node long, vec binary"), "ann-nodes"), each.select("node", F.explode("ids").alias("id"))


def first_graph(nodes: DataFrame, k: int, block: int = BLOCK, trees: int = TREES) -> DataFrame:
    """(u, v, sim): each node's nearest in its blocks of every projection."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _vectors(batch.column(1))
            for tree in range(trees):
                rng = np.random.default_rng(1000 + tree)
                planes = rng.standard_normal((m.shape[1], PLANES + 1)).astype(np.float32)
                p = m @ planes
                bits = ((p[:, :PLANES] > 0) << np.arange(PLANES)[::-1]).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), tree, np.int32)), pa.array(bits), pa.array(p[:, -1].astype(np.float64)), batch.column(0), batch.column(1)], ["tree", "code", "along", "node", "vec"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared(rows: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            at = 0
            while table.num_rows - at >= 2 * block or (last and at < table.num_rows):
                size = block if table.num_rows - at >= 2 * block else table.num_rows - at
                part = table.slice(at, size)
                at += size
                id_, m = part.column("node").to_numpy(), _vectors(part.column("vec").combine_chunks())
                sim = m @ m.T
                sim[id_[:, None] == id_[None, :]] = -2
                top = min(k, size - 1)
                if top > 0:
                    best = np.argpartition(-sim, top - 1, axis=1)[:, :top]
                    u = np.repeat(id_, top)
                    s = np.take_along_axis(sim, best, axis=1).ravel()
                    good = s > -2
                    yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(id_[best].ravel()[good]), pa.array(s[good])], ["u", "v", "sim"])
            rows[:] = table.slice(at).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 2 * block:
                    yield from compared(held, False)
        if held:
            yield from compared(held, True)

    coded = nodes.mapInArrow(code, "tree int, code long, along double, node long, vec binary")
    # Blocks are cut within partitions: those of a small table hold several blocks each, however many partitions the session asks for.
    most = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, nodes.count() * trees // (4 * block)))
    sorted_ = coded.repartitionByRange(parts, "tree", "code", "along").sortWithinPartitions("tree", "code", "along")
    return sorted_.mapInArrow(near, "u long, v long, sim float")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u; of an edge met twice the older one."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("u", "v", "sim", "fresh")


def _around(graph: DataFrame, reverse: int) -> DataFrame:
    """(u, v, fresh): forward neighbours and some reverse ones of every node."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
    order = Window.partitionBy("u").orderBy(F.desc("fresh"), F.xxhash64("u", "v"), "v")
    some = back.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reverse).select("u", "v", "fresh")
    return graph.select("u", "v", "fresh").unionByName(some).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))


def descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, sim): pairs of neighbours of one node that are nearer than the worst neighbour that u has."""
    worst = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    around = _around(graph, REVERSE)
    live = around.groupBy("u").agg(F.max("fresh").alias("any")).where("any = 1").select("u")
    known = nodes.join(worst.withColumnRenamed("u", "node"), "node").select(F.col("node").alias("v"), "vec", "worst")
    members = around.join(live, "u", "left_semi").join(known, "v").select("u", "v", "fresh", "worst", "vec")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = NEIGHBOURS + REVERSE
        for table in whole_groups(batches, "u", 16_000):
            u = table.column("u").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            size = np.diff(np.append(first, len(u)))
            group = np.repeat(np.arange(len(first)), size)
            slot = np.arange(len(u)) - first[group]
            v, fresh, worst = (table.column(c).to_numpy() for c in ("v", "fresh", "worst"))
            m = _vectors(table.column("vec").combine_chunks())
            grid = np.full((len(first), width), -1, np.int64)
            grid[group, slot] = np.arange(len(u))
            vec = np.zeros((len(first), width, m.shape[1]), np.float32)
            vec[group, slot] = m
            sim = vec @ vec.transpose(0, 2, 1)
            there = grid >= 0
            new = np.zeros(grid.shape, bool)
            new[group, slot] = fresh == 1
            limit = np.full(grid.shape, np.inf, np.float32)
            limit[group, slot] = worst
            ok = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (sim > limit[:, :, None])
            ok[:, np.arange(width), np.arange(width)] = False
            g, a, b = np.nonzero(ok)
            x, y, s = v[grid[g, a]], v[grid[g, b]], sim[g, a, b]
            order = np.lexsort((y, x))
            x, y, s = x[order], y[order], s[order]
            once = np.ones(len(x), bool)
            once[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[once]), pa.array(y[once]), pa.array(s[once])], ["u", "v", "sim"])

    return members.repartition("u").sortWithinPartitions("u").mapInArrow(local, "u long, v long, sim float")


def neighbour_graph(nodes: DataFrame, block: int = BLOCK, trees: int = TREES) -> DataFrame:
    """(u, v, sim, fresh): the graph after NN-descent."""
    start = first_graph(nodes, NEIGHBOURS, block, trees).withColumn("fresh", F.lit(1))
    graph = written(_best(start, NEIGHBOURS), "ann-graph")
    for _ in range(ROUNDS_BOUND):
        found = descend(graph, nodes).withColumn("fresh", F.lit(1))
        graph = written(_best(graph.withColumn("fresh", F.lit(0)).unionByName(found), NEIGHBOURS), "ann-graph", instead_of=graph)
        seen = graph.agg(F.count(F.lit(1)).alias("n"), F.sum("fresh").alias("new")).first()
        if not seen["n"] or seen["new"] < LEAST_NEW * seen["n"]:
            return graph
    raise RuntimeError(f"NN-descent still finds new neighbours after {ROUNDS_BOUND} rounds")


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, node, sim): the best nodes that a greedy walk from each query node finds, itself included."""
    around = _around(graph, REVERSE).select("u", "v")
    around = written(around, "ann-walk")
    asked = written(queries.join(nodes, F.col("q") == F.col("node")).select("q", F.col("vec").alias("asked")), "ann-asked")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", _vectors(batch.column(2)), _vectors(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["q", "node", "sim"])

    def pool(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= POOL).drop("rank")

    best = written(asked.select("q", F.col("q").alias("node"), F.lit(2.0).cast("float").alias("sim"), F.lit(False).alias("expanded")), "ann-pool")
    for _ in range(SEARCH_BOUND):
        order = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
        chosen = best.where("not expanded").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= EXPANDED).select("q", "node")
        chosen = written(chosen, "ann-chosen")
        if chosen.isEmpty():
            return best.select("q", "node", "sim")
        reached = chosen.join(around, chosen["node"] == around["u"]).select("q", F.col("v").alias("node")).distinct()
        fresh = reached.join(best.select("q", "node"), ["q", "node"], "left_anti")
        scored = fresh.join(nodes, "node").join(asked, "q").select("q", "node", "vec", "asked").mapInArrow(compare, "q long, node long, sim float")
        marked = best.join(chosen.withColumn("now", F.lit(True)), ["q", "node"], "left").select("q", "node", "sim", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"))
        best = written(pool(marked.unionByName(scored.withColumn("expanded", F.lit(False)))), "ann-pool", instead_of=best)
        delete(chosen)
    raise RuntimeError(f"the walk still has nodes to expand after {SEARCH_BOUND} rounds")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p * r), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(table: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank from 1, vec_id, score; ties to the smaller id.

    `is_query` is a condition on `id`. Rows whose vector is null, zero, holds a
    null or non-finite component or is not of the commonest length take no part,
    as query or candidate. Repeated
    rows count once; equal vectors of different ids are all candidates. Fewer
    than k candidates are all returned; an empty table gives no rows. Other
    columns are left out.
    """
    rows = written(usable(table, id_column, vector), "ann-rows")
    nodes, members = nodes_of(rows, k + 1)
    graph = neighbour_graph(nodes)
    asked = rows.where(is_query)
    # A query's node: the class of its vector.
    lookup = rows.join(members.where("id = node").select(F.col("id"), "node"), "id").select("v", "node")
    placed = asked.select(F.col("id").alias("query_id"), "v").join(lookup, "v").select("query_id", F.col("node").alias("q"), "v")
    placed = written(placed, "ann-queries")
    found = search(placed.select("q").distinct(), graph, nodes)
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    short = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= 3 * (k + 1)).select("q", "node")
    candidates = placed.join(short, "q").join(members, "node").where("id <> query_id").select("query_id", F.col("v").alias("qv"), "id")
    scored = candidates.join(rows, "id").select("query_id", F.col("id").alias("vec_id"), cosine(F.col("qv"), F.col("v")).alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
