"""N-gram Jaccard join by filtering under several global token orders.

If two sets of sizes a and b have a Jaccard similarity of at least t, then under
*any* total order of tokens their prefixes (the first n - ceil(t n) + 1 tokens)
share a token. Order 1 puts tokens rare in the corpus first (by a counting
sketch of fixed size): sets that share a prefix token under it are in one
bucket. Orders 2 and 3 are independent of it and of each other. A pair is a
candidate if it passes under all three; only then are its texts brought
together and its sets compared in full.

What is wanted are the links' components, so a bucket's pairs are never listed:
- Equal sets (by 128 bits) are one node, named by the smallest row id; only that row's text goes on.
- Equal buckets are one bucket. Tokens that the sketch calls frequent are spread over tasks by salt and counted by an
  aggregate that combines; so no task holds more than `most_in_task` rows of a token.
- A member carries the place of the bucket's token in its own order: as all
  tokens before it are unshared, places bound the overlap, and a pair whose
  sizes need more than the bound is no candidate.
- In rounds, each node is paired with one hub of its buckets. Links join
  components; a bucket whose nodes are all in one component needs nothing more.
  Rounds go on while each at least halves the members of open buckets.
- What is left are nodes of different components in one bucket. They meet by classes of size that the places allow;
  how many pairs that leaves is counted first, by kinds. Where it is many times the members (pages of one template: what they share is rare in
  the corpus, so it comes first in everyone's order and bounds nothing), a bucket is dealt anew under an order of its own:
  tokens that few of the bucket's members hold come first. That is a total order like any other, so linked sets still
  share a prefix token under it, but what all members hold now comes last, at places that rule pairs out.
- Each pair that passes all filters is compared, so no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import NOT_SPACE, U, between, flat, mix, prefix, slices, window_hashes, word_hashes, words
from .components import components
from .repeats import whole_groups
from .store import free, with_row_id, written

SHINGLE = 5
#: The similarity as a fraction of whole numbers: 75 / 100.
NUMERATOR, DENOMINATOR = 75, 100
#: Counters of the sketch: its size is fixed, whatever the corpus. It is summed in CHUNKS parts, of GROUPS groups of tasks first.
SKETCH_BITS, CHUNKS, GROUPS = 20, 64, 64
#: Rows of one token that one task may hold, and tasks over which those of a more frequent one are spread.
MOST_IN_TASK, SALTS = 1 << 14, 64
#: Ratio of neighbouring classes of size.
STEP = 1.05
#: Pairs a member that a bucket may make as it is; members that a bucket's own order is made from, and the share of them (one in so many) that must hold
#: a token for it to come late.
PAIRS, SAMPLED, HELD_BY = 32, 32, 8
ORDER_SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0))
SECOND_ID = U(0x452821E638D01377)


def token_sets(text: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and offsets. A text of fewer words has its whole sequence as one."""
    body, off = flat(text)
    starts, ends, first = words(body, off, NOT_SPACE)
    codes = word_hashes(body, starts, ends, lower=True)
    grams = window_hashes(codes, shingle)
    n_words = np.diff(first)
    size = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint64)
    short = (n_words > 0) & (n_words < shingle)
    whole = mix(between(prefix(codes), first[:-1][short], first[1:][short]) ^ mix(n_words[short].astype(np.uint64)))
    out[at[:-1][short]] = whole
    for i in np.flatnonzero(n_words >= shingle).tolist():
        part = out[at[i] : at[i + 1]]
        part[:] = grams[first[i] : first[i] + size[i]]
        part.sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[at]


def set_ids(tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, independent of each other; equal sets have equal ones."""
    size = mix(np.diff(off).astype(np.uint64))

    def one(codes: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes)])
        return mix((sums[off[1:]] - sums[off[:-1]]) ^ size)

    return one(mix(tokens)), one(mix(tokens ^ SECOND_ID))


def prefix_size(n):
    """Tokens that a set of n must show under an order: n - ceil(t n) + 1."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def summaries(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows of two kinds from one pass: (rid, doc_id, h1, h2, n) of each document, and (chunk, team, counts) of each task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "doc_id", "h1", "h2", "n", "chunk", "team", "counts"]
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in slices(batches, "text"):
            tokens, off = token_sets(batch.column(2), shingle)
            counts += np.bincount((tokens >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.int32)
            k = batch.num_rows
            h1, h2 = set_ids(tokens, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.diff(off)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if counts.any():
            parts = [c.tobytes() for c in np.split(counts, CHUNKS)]
            team = np.full(CHUNKS, TaskContext.get().partitionId() % GROUPS, np.int32)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(CHUNKS, pa.int64()) for _ in range(5)), pa.array(range(CHUNKS), pa.int32()), pa.array(team), pa.array(parts, pa.binary())], names)

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, h1 long, h2 long, n long, chunk int, team int, counts binary")


def sketch_of(table: DataFrame) -> np.ndarray:
    """The tasks' sketches added up: 2**SKETCH_BITS counters, whatever the corpus; sums go by chunk and group of tasks, then by chunk."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for chunk, team, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                total[chunk, team] = total.get((chunk, team), 0) + np.frombuffer(part, np.int32).astype(np.int64)
        sums = [np.minimum(t, (1 << 31) - 1).astype(np.int32).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in total], pa.int32()), pa.array([t for _, t in total], pa.int32()), pa.array(sums, pa.binary())], ["chunk", "team", "counts"])

    schema = "chunk int, team int, counts binary"
    parts = table.where("chunk is not null").select("chunk", "team", "counts").repartition("chunk", "team").mapInArrow(add, schema)
    parts = parts.withColumn("team", F.lit(0)).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), np.int32)
    for row in parts.collect():  # CHUNKS rows, of a fixed size
        out[row["chunk"]] = np.frombuffer(row["counts"], np.int32)
    return out.ravel()


def postings(texts: DataFrame, sketch, shingle: int, most_in_task: int) -> DataFrame:
    """(token, salt, sid, n, place) for the tokens of each set's prefix under order 1. salt: -1, or a number of the set's where
    the token may be held by more than `most_in_task` sets. Needs sid and text, one row a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for batch in slices(batches, "text"):
            tokens, off = token_sets(batch.column(1), shingle)
            sid, size = batch.column(0).to_numpy(), np.diff(off)
            times = often[(tokens >> U(64 - SKETCH_BITS)).astype(np.int64)]
            key = (times.astype(np.uint64) << U(32)) | (mix(tokens ^ ORDER_SEEDS[0]) >> U(32))
            chosen, owner, places = [], [], []
            for i in np.flatnonzero(size).tolist():
                k = key[off[i] : off[i + 1]]
                limit = np.partition(k, prefix_size(len(k)) - 1)[prefix_size(len(k)) - 1]
                found = np.flatnonzero(k <= limit)  # all of a tie at the limit
                found = found[np.argsort(k[found], kind="stable")]
                chosen.append(found + off[i])
                owner.append(np.full(len(found), i))
                # Tokens of equal keys share the first one's place: the bound stays one from above.
                places.append(np.searchsorted(k[found], k[found]))
            if chosen:
                own, at = np.concatenate(owner), np.concatenate(chosen)
                salt = np.where(times[at] > most_in_task, (mix(sid.view(np.uint64)) % U(SALTS)).astype(np.int32)[own], -1)
                columns = [tokens[at].view(np.int64), salt.astype(np.int32), sid[own], size[own].astype(np.int32), np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "salt", "sid", "n", "place"])

    return texts.select("sid", "text").mapInArrow(run, "token long, salt int, sid long, n int, place int")


def buckets(post: DataFrame) -> DataFrame:
    """(bucket, sid, n, place): sets that share a prefix token. Tokens shared by just the same sets are one bucket, with the
    smallest of each set's places; tokens of one set are none."""
    names = ["token", "salted", "sid", "n", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread: list[pa.RecordBatch] = []

        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                salted = batch.column(1).to_numpy() >= 0
                if salted.any():
                    part = batch.filter(pa.array(salted))
                    spread.append(pa.RecordBatch.from_arrays([part.column(0), pa.array(np.ones(part.num_rows, bool)), *(part.column(k) for k in (2, 3, 4))], names))
                    batch = batch.filter(pa.array(~salted))
                yield batch

        for table in whole_groups(plain(), "token", 200_000):
            yield from spread
            spread.clear()
            token, sid, n, place = (table.column(c).to_numpy() for c in ("token", "sid", "n", "place"))
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            token, sid, n, place = token[fresh], sid[fresh], n[fresh], place[fresh]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            code = mix(np.add.reduceat(mix(sid.view(np.uint64)), first) ^ mix(size.astype(np.uint64)))
            shared = np.repeat(size > 1, size)
            code, sid, n, place = np.repeat(code, size)[shared], sid[shared], n[shared], place[shared]
            if not len(code):
                continue
            order = np.lexsort((sid, code))
            code, sid, n, place = code[order], sid[order], n[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (sid[1:] != sid[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(code[new].view(np.int64)), pa.array(np.zeros(len(new), bool)), pa.array(sid[new]), pa.array(n[new]), pa.array(np.minimum.reduceat(place, new))], names)
        yield from spread

    found = post.repartition("token", "salt").sortWithinPartitions("token", "sid").mapInArrow(run, "token long, salted boolean, sid long, n int, place int")
    found = written(found, "jaccard-postings")
    hot = found.where("salted")
    # Sets of a frequent token: counted by an aggregate that combines, written so that the join's hot keys can be split.
    counts = hot.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("sid")).alias("x")).where("k > 1")
    counts = written(counts.select("token", F.xxhash64("k", "x").alias("bucket")), "jaccard-frequent")
    both = found.where("not salted").select(F.col("token").alias("bucket"), "sid", "n", "place").unionByName(hot.join(counts, "token").select("bucket", "sid", "n", "place"))
    return both.groupBy("bucket", "sid").agg(F.first("n").alias("n"), F.min("place").alias("place"))


def with_prefixes(texts: DataFrame, shingle: int) -> DataFrame:
    """(sid, text, p2, p3): each set's prefixes under orders 2 and 3, tokens by 32 bits (equal tokens stay equal, so no candidate is lost)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, off = token_sets(batch.column(1), shingle)
            columns = []
            for seed in ORDER_SEEDS[1:]:
                key = mix(tokens ^ seed)
                parts = []
                for i in range(batch.num_rows):
                    k = key[off[i] : off[i + 1]]
                    parts.append(np.partition(k, prefix_size(len(k)) - 1)[: prefix_size(len(k))] if len(k) else k)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                low = (np.concatenate(parts) & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(low)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["sid", "text", "p2", "p3"])

    return texts.select("sid", "text").mapInArrow(run, "sid long, text string, p2 array<int>, p3 array<int>")


def could_link(n: Column, place: Column, other_n: Column, other_place: Column) -> Column:
    """False where sizes or places rule out the similarity: an overlap of t / (1 + t) (n + m) is needed, and no token before a shared one is shared."""
    n, other_n = n.cast("long"), other_n.cast("long")
    need = F.ceil(NUMERATOR * (n + other_n) / (NUMERATOR + DENOMINATOR))
    return (DENOMINATOR * F.least(n, other_n) >= NUMERATOR * F.greatest(n, other_n)) & (n - place >= need) & (other_n - other_place >= need)


def compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, linked) of each pair of sets: prefixes under orders 2 and 3 must meet as well; what passes is compared in full."""

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        if DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a", 1 << 20), "text_b", 1 << 20):
            ta, oa = token_sets(batch.column(2), shingle)
            tb, ob = token_sets(batch.column(3), shingle)
            out = [linked(ta[oa[i] : oa[i + 1]], tb[ob[i] : ob[i + 1]]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    side = lambda x, *columns: texts.select(F.col("sid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    met = F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")
    sifted = pairs.select("a", "b").join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b").select("a", "b", met.alias("met"))
    sifted = written(sifted, "jaccard-candidates")
    two = sifted.where("met").select("a", "b").join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
    return two.mapInArrow(run, "a long, b long, linked boolean").unionByName(sifted.where("not met").select("a", "b", F.lit(False).alias("linked")))


def _with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("sid"))
    return members.join(labels.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))


AS_HUB = ("sid", "n", "place", "component")


def _open_members(members: DataFrame, rank: Column) -> DataFrame:
    """Members of buckets that still hold more than one component, beside their bucket's hub: the member of the highest rank."""
    hub = F.max_by(F.struct(*[F.col(c).alias(f"hub_{c}") for c in AS_HUB]), rank)
    mixed = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), hub.alias("hub")).where("lo <> hi").select("bucket", "hub.*")
    # Written, so that both sides of the join are plain shuffles and Spark can split a large bucket.
    return members.join(written(mixed, "jaccard-hubs"), "bucket")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(STEP)))


def _asking(live: DataFrame) -> DataFrame:
    """Members with the classes of size in which they look for partners: of 0.75 of their size up to what their place leaves possible."""
    n, place = F.col("n").cast("long"), F.col("place").cast("long")
    lo = F.ceil(NUMERATOR * n / DENOMINATOR)
    hi = F.least(n, F.floor((DENOMINATOR * n - (NUMERATOR + DENOMINATOR) * place) / NUMERATOR))
    return live.where(lo <= hi).withColumn("step", F.explode(F.sequence(_size_class(lo), _size_class(hi))))


def _near(live: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(bucket, name): how many pairs of one group of the keys sizes and places allow, counted by kinds of size and place and not pair by pair."""
    kinds = live.groupBy(*keys, "n", "place").agg(F.count(F.lit(1)).alias("c"))
    found = kinds.select(*keys, _size_class(F.col("n")).alias("step"), F.col("n").alias("hub_n"), F.col("place").alias("hub_place"), F.col("c").alias("hub_c"))
    allowed = could_link(F.col("n"), F.col("place"), F.col("hub_n"), F.col("hub_place")) & (F.col("hub_n") <= F.col("n"))
    return _asking(kinds).join(found, [*keys, "step"]).where(allowed).groupBy("bucket").agg(F.sum(F.col("c") * F.col("hub_c")).alias(name))


def _open_pairs(live: DataFrame) -> DataFrame:
    """(bucket, pairs): how many pairs of different components `_rest` would make of each bucket (those of equal sizes twice)."""
    return _near(live, ["bucket"], "every").join(_near(live, ["bucket", "component"], "same"), "bucket").select("bucket", (F.col("every") - F.col("same")).alias("pairs"))


def _mixed(live: DataFrame) -> DataFrame:
    """Members of buckets of more than one component, and how many the bucket has. Buckets of the same members are one, with the smallest places."""
    size = live.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("sid")).alias("x"))
    size = size.where("lo <> hi").select("bucket", "size", F.xxhash64("size", "x").alias("code"))
    same = live.join(size, "bucket").groupBy(F.col("code").alias("bucket"), "sid")
    return same.agg(F.first("n").alias("n"), F.min("place").alias("place"), F.first("component").alias("component"), F.first("size").alias("size"))


def _dealt_anew(large: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(bucket, sid, n, place, component): members of given buckets in buckets of the tokens that begin their sets under the bucket's own order.

    The order is by how many of `SAMPLED` members hold a token, as far as one in `HELD_BY` does, then by hash: it is the same for all members of a
    bucket, whatever the sample, so nothing is lost by sampling.
    """

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, off = token_sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), np.diff(off))), pa.array(tokens.view(np.int64))], ["bucket", "token"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, off = token_sets(batch.column(1), shingle)
            bucket, sid, n, component = (batch.column(k).to_numpy() for k in (0, 2, 3, 4))
            chosen, owner, places = [], [], []
            for i, (common, held) in enumerate(zip(batch.column(5), batch.column(6), strict=True)):
                own = tokens[off[i] : off[i + 1]]
                known = common.values.to_numpy().view(np.uint64) if common.is_valid else np.zeros(0, np.uint64)
                times = np.zeros(len(own), np.uint64)
                if len(known):
                    order = np.argsort(known)
                    at = order[np.minimum(np.searchsorted(known, own, sorter=order), len(known) - 1)]
                    times = np.where(known[at] == own, held.values.to_numpy()[at].astype(np.uint64), U(0))
                key = (times << U(32)) | (mix(own ^ ORDER_SEEDS[0]) >> U(32))
                size = prefix_size(len(own))
                limit = np.partition(key, size - 1)[size - 1]
                found = np.flatnonzero(key <= limit)
                found = found[np.argsort(key[found], kind="stable")]
                chosen.append(own[found])
                owner.append(np.full(len(found), i))
                places.append(np.searchsorted(key[found], key[found]))
            if chosen:
                own = np.concatenate(owner)
                name = mix(np.concatenate(chosen) ^ mix(bucket.view(np.uint64)[own])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(sid[own]), pa.array(n[own]), pa.array(np.concatenate(places).astype(np.int32)), pa.array(component[own])], ["bucket", "sid", "n", "place", "component"])

    few = large.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("sid"), "sid"))).where(F.col("nth") <= SAMPLED).select("bucket", "sid")
    common = few.join(texts.select("sid", "text"), "sid").select("bucket", "text").mapInArrow(tokens_of, "bucket long, token long").groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("held"))
    # At most HELD_BY times the tokens of a set.
    lists = common.where(F.col("held") * HELD_BY >= SAMPLED).groupBy("bucket").agg(F.collect_list(F.struct("token", "held")).alias("common")).select("bucket", "common.token", "common.held")
    rows = large.select("bucket", "sid", "n", "component").join(written(lists, "jaccard-orders"), "bucket", "left").join(texts.select("sid", "text"), "sid")
    again = rows.select("bucket", "text", "sid", "n", "component", F.col("token").alias("common"), "held").mapInArrow(dealt, "bucket long, sid long, n int, place int, component long")
    return again.groupBy("bucket", "sid").agg(F.first("n").alias("n"), F.min("place").alias("place"), F.first("component").alias("component"))


def _thinned(live: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(bucket, sid, n, place, component): buckets that would make more than `PAIRS` pairs a member are dealt anew, again and again while that at least
    halves their pairs; all others as they are."""
    left, out = written(_mixed(live), "jaccard-left"), None
    while True:
        counted = written(left.join(_open_pairs(left), "bucket", "left"), "jaccard-left", instead_of=left)
        is_large = F.coalesce(F.col("pairs") > PAIRS * F.col("size"), F.lit(False))
        small, large = (counted.where(c).drop("pairs") for c in (~is_large, is_large))
        out = small if out is None else out.unionByName(small)
        before = counted.where(is_large).select("bucket", "pairs").distinct().agg(F.sum("pairs")).first()[0]
        if not before:
            return out
        left = written(_mixed(_dealt_anew(large, texts, shingle)), "jaccard-left")
        after = _open_pairs(left).agg(F.sum("pairs")).first()[0] or 0
        if 2 * after > before:
            return out.unionByName(left if after < before else large)


def _rest(live: DataFrame) -> DataFrame:
    """(a, b): the pairs of different components in one bucket that sizes and places allow; the larger set looks for partners by classes of size."""
    asking = _asking(live)
    found = live.select("bucket", _size_class(F.col("n")).alias("step"), *[F.col(c).alias(f"hub_{c}") for c in AS_HUB])
    near = could_link(F.col("n"), F.col("place"), F.col("hub_n"), F.col("hub_place")) & (F.col("component") != F.col("hub_component"))
    once = (F.col("hub_n") < F.col("n")) | ((F.col("hub_n") == F.col("n")) & (F.col("hub_sid") < F.col("sid")))
    return asking.join(found, ["bucket", "step"]).where(near & once).select(F.least("sid", "hub_sid").alias("a"), F.greatest("sid", "hub_sid").alias("b")).distinct()


def linked_sets(docs: DataFrame, shingle: int = SHINGLE, most_in_task: int = MOST_IN_TASK) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rid, doc_id, h1, h2, n) of all rows; (h1, h2, sid, least, n) of all sets: smallest rid and doc_id; and (id, component) of all sets that have a link, or None.

    Needs rid, doc_id and text.
    """
    spark = docs.sparkSession
    table = written(summaries(docs, shingle), "jaccard-rows")
    rows = table.where("chunk is null").select("rid", "doc_id", "h1", "h2", "n")
    sets = written(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("sid"), F.min("doc_id").alias("least"), F.first("n").alias("n")), "jaccard-sets")
    sketch = spark.sparkContext.broadcast(sketch_of(table))
    reps = written(docs.join(sets.select(F.col("sid").alias("rid")), "rid").select(F.col("rid").alias("sid"), "text"), "jaccard-texts")
    members = written(buckets(postings(reps, sketch, shingle, most_in_task)), "jaccard-members")
    texts = written(with_prefixes(reps.join(members.select("sid").distinct(), "sid"), shingle), "jaccard-prefixes")
    degree = members.groupBy("sid").agg(F.count(F.lit(1)).alias("degree"))
    live, before, turn = written(members.join(degree, "sid"), "jaccard-open"), None, 0
    labels = tried = None
    plain = ("bucket", "sid", "n", "place", "degree")
    while True:
        # First the set that most buckets hold, which edited copies have most in common with; later any other.
        rank = F.struct("degree", "sid") if not turn else F.struct(F.xxhash64("sid", F.lit(turn)), "sid")
        live = written(_open_members(_with_component(live.select(*plain), labels), rank), "jaccard-open", instead_of=live)
        left = live.count()
        if not left:
            return rows, sets, labels
        if before is not None and 2 * left > before:
            break
        before, turn = left, turn + 1
        near = could_link(F.col("n"), F.col("place"), F.col("hub_n"), F.col("hub_place")) & (F.col("component") != F.col("hub_component"))
        shared = live.where(near).groupBy("sid", "hub_sid").agg(F.count(F.lit(1)).alias("k"))
        best = shared.groupBy("sid").agg(F.max_by("hub_sid", F.struct("k", "hub_sid")).alias("hub"))
        pairs = best.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        done = written(compared(pairs, texts, shingle), "jaccard-compared")
        tried = done if tried is None else tried.unionByName(done)
        labels = components(tried.where("linked"))
    rest = _rest(_thinned(live.select("bucket", *AS_HUB), texts, shingle)).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    done = written(compared(rest, texts, shingle), "jaccard-compared")
    if not done.where("linked").isEmpty():
        labels = components(tried.unionByName(done).where("linked"))
    return rows, sets, labels


def classes(keyed: DataFrame, most_in_task: int = MOST_IN_TASK) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, h1, h2, n) of rows, and (h1, h2, sid, component, component_id) of sets. Needs rid, doc_id and text.

    sid is a set's smallest rid, component the smallest rid and component_id the smallest doc_id of all that links reach.
    """
    rows, sets, labels = linked_sets(keyed, most_in_task=most_in_task)
    sets = _with_component(sets, labels)
    least = written(sets.groupBy("component").agg(F.min("least").alias("component_id")), "jaccard-components")
    return rows, sets.join(least, "component").select("h1", "h2", "sid", "component", "component_id")


def report(docs: DataFrame, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null and empty texts, and texts without words, have no shingle and no link:
    component_id is their own doc_id. Repeated rows are linked documents of equal
    id; a null doc_id gives null where no other id is reached. A text of any
    length is one set, held in one task; an empty table gives no rows; other
    columns are left out, whatever their names.
    """
    keyed = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows, sets = classes(keyed, most_in_task)
    # Written, so that the rows of a set of very many copies can be split in their join.
    sets = written(sets.select("h1", "h2", "component_id"), "jaccard-labels")
    some = rows.where("n > 0").join(sets, ["h1", "h2"]).select("doc_id", "n", "component_id")
    every = some.unionByName(rows.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the one of the smallest id (null first; of repeated rows one).

    Null and empty texts and texts without words have no copies and all stay. All columns stay, whatever their names; an empty table gives none.
    """
    name = free(docs.columns, "rid")
    keyed = with_row_id(docs, name=name)
    own = keyed.select(F.col(name).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, sets = classes(own)
    stay = sets.where("sid = component").select("sid").unionByName(rows.where("n = 0").select(F.col("rid").alias("sid")))
    return keyed.join(stay.withColumnRenamed("sid", name), name, "left_semi").select(*docs.columns)
