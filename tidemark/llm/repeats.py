"""Repeated stretches of a fixed length: what exact-substring operators share.

To find every stretch of `length` elements (bytes, or words) that occurs more
than once without moving all of them, each is led by an *anchor*: of the
`gram`-element grams inside it, the one of the smallest hash (the leftmost of
equal ones). Equal stretches have equal anchors at equal places, so they can be
looked for among stretches of one anchor alone. Stretches that follow each other
and share an anchor form one *fragment*, so rows are two in (length - gram + 2)
elements, not one an element.

1. `anchored` reads the texts and gives a row a fragment: anchor hash, a digest
   of the fragment's whole content, row id and place.
2. Anchors that occur once drop out (counts are combined before the shuffle).
3. Fragments equal as a whole are one *kind*, whose copies are only counted.
   Where one anchor has several kinds, the first copy of each goes on with its
   content, to be compared stretch by stretch by the operator.
4. `covered` gives each row's stretches found, as ranges of elements.

A row's key is `rid` (see store.with_row_id). Fragments are of one kind if their
anchors' hashes and 128 bits of a cryptographic digest of their content agree.
Polynomial hashes, of however many families, would not do: texts of two letters
can be built whose differences cancel in all of them at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import BYTE_CODES, NOT_SPACE, U, flat, ranges, slices, window_hashes, word_hashes, words
from .store import written


@dataclass(frozen=True)
class Kind:
    """Elements of a text, bytes or words, and the lengths of stretches and of anchors."""

    length: int
    gram: int
    words: bool = False


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each `width` hashes in a row; the leftmost, if their leading bits are equal."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    mask = U((1 << max(20, n.bit_length())) - 1)
    low = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n - width + 1], low[width - span :][: n - width + 1])
    return (low & mask).astype(np.int64)


def fragments(values: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor's place from start, anchor hash) of all fragments of a slice of texts."""
    size = np.diff(off)
    windows = np.maximum(size - length + 1, 0)
    at = ranges(off[:-1], windows)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    grams = window_hashes(values, gram)
    lead = smallest(grams, length - gram + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = lead[1:] != lead[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, anchor = at[first], lead[first]
    text = np.repeat(np.arange(len(size)), windows)[first]
    return text, start - off[text], last - first + 1, anchor - start, grams[anchor]


def digests(raw: bytes, begin: np.ndarray, end: np.ndarray, spaced: bool, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a digest of 128 bits of each stretch of bytes (spaced: of its words, joined by one blank), and of a number beside it."""
    cut = (raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True))
    if spaced:
        cut = (b" ".join(c.split()) for c in cut)
    if salt is not None:
        cut = (n.to_bytes(8, "little") + c for n, c in zip(salt.tolist(), cut, strict=True))
    halves = np.frombuffer(b"".join([hashlib.blake2b(c, digest_size=16).digest() for c in cut]), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def anchored(docs: DataFrame, kind: Kind) -> DataFrame:
    """(anchor, frag, check, rid, at) of every fragment: its anchor's hash, both halves of its digest, and in `at` its start, the anchor's distance and
    the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rid = batch.column(0).to_numpy()
            body, off = flat(batch.column(1))
            if kind.words:
                w_start, w_end, first = words(body, off, NOT_SPACE)
                values, off = word_hashes(body, w_start, w_end), first
            else:
                values = BYTE_CODES[body]
            text, start, windows, ahead, anchor = fragments(values, off, kind.length, kind.gram)
            begin, end = off[text] + start, off[text] + start + windows + kind.length - 1
            if kind.words:
                begin, end = w_start[begin], w_end[end - 1]
            # Stretches of equal content whose anchors stand at different places differ.
            frag, check = digests(body.tobytes(), begin, end, kind.words, ahead)
            at = (start << 16) | (ahead << 8) | windows
            yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor.view(np.int64), frag, check)), pa.array(rid[text]), pa.array(at)], ["anchor", "frag", "check", "rid", "at"])

    return docs.select("rid", "text").mapInArrow(run, "anchor long, frag long, check long, rid long, at long")


def texts_of(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """The content of wanted fragments (anchor, rid, at): (anchor, rid, at, body). Words are joined by one blank."""
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "at")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            body, off = flat(batch.column(1))
            if kind.words:
                w_start, w_end, first = words(body, off, NOT_SPACE)
            want = batch.column(2)
            per = np.diff(want.offsets.to_numpy())
            rows = want.flatten()
            text = np.repeat(np.arange(batch.num_rows), per)
            at = rows.field("at").to_numpy()
            start, span = at >> 16, (at & 255) + kind.length - 1
            if kind.words:
                begin, end = w_start[first[text] + start], w_end[first[text] + start + span - 1]
            else:
                begin, end = off[text] + start, off[text] + start + span
            raw = body.tobytes()
            cut = [raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
            if kind.words:
                cut = [b" ".join(c.split()) for c in cut]
            yield pa.RecordBatch.from_arrays([rows.field("anchor"), batch.column(0).take(pa.array(text)), rows.field("at"), pa.array(cut, pa.binary())], ["anchor", "rid", "at", "body"])

    joined = docs.select("rid", "text").join(lists, "rid").select("rid", "text", "wanted")
    return joined.mapInArrow(run, "anchor long, rid long, at long, body binary")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Batches of rows sorted by key, joined and cut anew so that a key's rows stay together and tables are near `most` rows."""
    held: list[pa.RecordBatch] = []
    count, goal = 0, most
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < goal:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        while at + most <= count and (later := change[change > at]).size:
            good = later[later >= at + most]
            to = int(good[0]) if len(good) else int(later[-1])
            yield table.slice(at, to - at)
            at = to
        held = table.slice(at).to_batches()
        count -= at
        # One key alone has the rest: look again when that has doubled.
        goal = most if count < most else 2 * count
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shared_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, times) of keys that more than one row has. Counts combine before the shuffle; the table is written, so that a
    join with it has plain shuffles on both sides and Spark can split a hot key."""
    return written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeats-shared")


def equal_windows(rows: DataFrame, keep_first: bool) -> DataFrame:
    """(rid, at, lo, hi) of windows (w1, w2, rid, at, k) that others equal by both halves of a digest; keep_first: only those that an earlier one equals.

    Each window is a row and equal ones are counted by an aggregate that combines, so no group is ever in one place.
    """
    rows = written(rows, "repeats-windows")
    start = F.shiftright("at", 16) + F.col("k")
    groups = rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("rid", start.alias("start"))).alias("least")).where("times > 1")
    hits = rows.join(written(groups.select("w1", "w2", "least"), "repeats-shared"), ["w1", "w2"])
    if keep_first:
        hits = hits.where((F.col("rid") != F.col("least.rid")) | (start != F.col("least.start")))
    return hits.select("rid", "at", F.col("k").alias("lo"), (F.col("k") + 1).alias("hi"))


def covered(docs: DataFrame, kind: Kind, compare: Callable[[DataFrame], DataFrame], keep_first: bool) -> DataFrame:
    """(rid, spans): element ranges [start, end) covered by repeated stretches, not merged, rows without any left out.

    `compare` gets (anchor, rid, at, body), the first copy of each kind of fragment whose anchor has several kinds, and
    returns (rid, at, lo, hi): runs of its windows that are repeated in another kind.
    keep_first: the first occurrence by (rid, start) of each stretch doesn't count.
    """
    rows = anchored(docs, kind)
    counts = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("frag", "check") for f in (F.min, F.max)])
    # Written first, so that both sides of the join are shuffled for it and Spark can split a hot anchor's rows.
    mixed = (F.col("min_frag") != F.col("max_frag")) | (F.col("min_check") != F.col("max_check"))
    often = written(counts.where("n > 1").select("anchor", mixed.alias("mixed")), "repeats-anchors")
    repeated = written(rows.join(often, "anchor"), "repeats-rows")
    kinds = repeated.groupBy("anchor", "frag", "check").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at")).alias("first"), F.first("mixed").alias("mixed"))
    kinds = written(kinds.select("anchor", "frag", "check", "n", F.col("first.rid").alias("first_rid"), F.col("first.at").alias("first_at"), "mixed"), "repeats-kinds")
    wanted = kinds.where("mixed").select("anchor", F.col("first_rid").alias("rid"), F.col("first_at").alias("at"))
    found = compare(written(texts_of(docs, wanted, kind), "repeats-bodies"))
    found = found.groupBy(F.col("rid").alias("first_rid"), F.col("at").alias("first_at")).agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    settled = kinds.drop("mixed").join(found, ["first_rid", "first_at"], "left").where("n > 1 or parts is not null").withColumn("parts", F.coalesce("parts", F.expr("cast(array() as array<struct<lo:int,hi:int>>)")))
    # Written for the same reason: a fragment of very many copies is split by Spark where both sides of its join are plain shuffles.
    settled = written(settled, "repeats-settled")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("at").bitwiseAND(255).cast("int").alias("hi")))
    is_first = (F.col("rid") == F.col("first_rid")) & (F.col("at") == F.col("first_at"))
    parts = F.when((F.col("n") > 1) & ~(is_first if keep_first else F.lit(False)), whole).otherwise(F.col("parts"))
    start = F.shiftright("at", 16)
    each = repeated.select("anchor", "frag", "check", "rid", "at").join(settled, ["anchor", "frag", "check"])
    each = each.select("rid", F.explode(F.transform(parts, lambda p: F.struct((start + p["lo"]).alias("start"), (start + p["hi"] + (kind.length - 1)).alias("end")))).alias("span"))
    return each.groupBy("rid").agg(F.collect_list("span").alias("spans"))


def marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each of n elements that a range covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
