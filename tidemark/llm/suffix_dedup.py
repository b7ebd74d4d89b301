"""Exact substring removal over bytes by a hash-compared suffix sort.

Every 200-byte string that starts at two places is removed at both. Candidates
come from repeats.py. Where one anchor has several kinds of fragments, the
suffixes at all their windows are sorted: prefix polynomial hashes give the
longest common extension of two suffixes by binary search, so one comparison
takes a number of steps logarithmic in the length, and a mergesort of such
comparisons orders them. Then the bytes of all neighbours are compared: equal
ones are repeats, and where two are out of order, since hashes of different
bytes agreed, their windows are looked through one by one. Hashes decide nothing.

An anchor with more than `MOST` kinds of fragments is split by its windows'
distance before it, in steps of SPAN: all windows of a step hold one *core* of
bytes around the anchor, so equal ones have equal cores, and cores of one
fragment only need no sort. A core of more than `MOST_OF_CORE` kinds is counted
window by window by a digest, without a group in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import BYTE_CODES, between, flat, mix, powers, prefix, ranges, slices
from .repeats import Kind, covered, digests, equal_windows, marked, shared_keys, whole_groups
from .store import with_row_id, written

LENGTH = 200
GRAM = 32
#: Kinds of fragments that one sort holds at most of an anchor and of a core, and distances that share a core.
MOST, MOST_OF_CORE, SPAN = 512, 4096, 22


class SuffixSorter:
    """Suffixes of one byte array, compared over their first `length` bytes."""

    def __init__(self, body: np.ndarray, length: int) -> None:
        self.body, self.length = body, length
        self.sums = prefix(BYTE_CODES[body])
        self.undo = powers(len(self.sums))[1]
        self.steps = [1 << k for k in range(length.bit_length() - 1, -1, -1)]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of suffixes a and b, `length` at most: a binary search over prefix hashes."""
        sums, undo = self.sums, self.undo
        sa, sb, ua, ub = sums[a], sums[b], undo[a], undo[b]
        m = np.zeros(len(a), np.int64)
        for step in self.steps:
            t = m + step
            fits = t <= self.length
            t = np.where(fits, t, m)
            same = (sums[a + t] - sa) * ua == (sums[b + t] - sb) * ub
            m = np.where(same, t, m)
        return m

    def before(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a < b, a == b) by content."""
        m = self.extension(a, b)
        equal = m >= self.length
        m = np.minimum(m, self.length - 1)
        return ~equal & (self.body[a + m] < self.body[b + m]), equal

    def sort(self, suffixes: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Sorts suffixes within segments (numbers that never fall) by a bottom-up mergesort; all merges of a level at once."""
        n = len(suffixes)
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        size = np.diff(np.append(first, n))
        base, total = np.repeat(first, size), np.repeat(size, size)
        out, place = suffixes.copy(), np.arange(n) - base
        run = 1
        while run < (size.max() if len(size) else 0):
            mine = place // run
            other = (mine ^ 1) * run
            there = np.clip(total - other, 0, run)
            lo, hi = np.zeros(n, np.int64), there.copy()
            left = mine % 2 == 0
            busy = np.flatnonzero(lo < hi)
            while len(busy):
                mid = (lo[busy] + hi[busy]) // 2
                less, equal = self.before(out[base[busy] + other[busy] + mid], out[busy])
                right = less | (equal & ~left[busy])
                lo[busy] = np.where(right, mid + 1, lo[busy])
                hi[busy] = np.where(right, hi[busy], mid)
                busy = busy[lo[busy] < hi[busy]]
            goal = base + (mine // 2) * 2 * run + (place - mine * run) + lo
            merged = np.empty_like(out)
            merged[goal] = out
            out = merged
            run *= 2
        return out


def repeated_windows(table: pa.Table, length: int = LENGTH) -> np.ndarray:
    """For each window of each fragment, in a row: whether another fragment of the same key has its bytes. step: -1, or which distances count."""
    body, off = flat(table.column("body").combine_chunks())
    at, step = table.column("at").to_numpy(), table.column("step").to_numpy()
    windows, ahead = at & 255, (at >> 8) & 255
    key = table.column("key").to_numpy()
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    suffix = ranges(off[:-1], windows)
    first = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(at)), windows)
    # Equal windows stand equally far before their anchor.
    distance = ahead[owner] - (suffix - off[owner])
    bucket = group[owner] * 256 + distance
    head = np.zeros(len(suffix), np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | body[suffix + k].astype(np.uint64)
    order = np.lexsort((head, bucket))
    order = order[((step[owner] < 0) | (distance // SPAN == step[owner]))[order]]
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = (bucket[order][1:] == bucket[order][:-1]) & (head[order][1:] == head[order][:-1])
    keep = tied[1:] | tied[:-1]
    chosen = order[keep]
    hit = np.zeros(len(suffix), bool)
    if not len(chosen):
        return hit
    sorter = SuffixSorter(body, length)
    segment = np.cumsum(~tied[:-1][keep])
    ordered = sorter.sort(suffix[chosen], segment)
    same = np.flatnonzero(segment[1:] == segment[:-1])
    # From a place in the joined bytes back to the window's number.
    number = lambda p: (lambda f: first[f] + p - off[f])(np.searchsorted(off, p, side="right") - 1)
    rows = sliding_window_view(body, length)
    unsorted = []
    for k in range(0, len(same), 20_000):
        at_ = same[k : k + 20_000]
        x, y = ordered[at_], ordered[at_ + 1]
        differ = rows[x] != rows[y]
        equal, place = ~differ.any(axis=1), differ.argmax(axis=1)
        hit[number(x[equal])] = True
        hit[number(y[equal])] = True
        unsorted.append(segment[at_][~equal & (body[x + place] >= body[y + place])])
    # Where hashes of different bytes agreed, a segment may be out of order: its windows are compared as they are.
    for s in np.unique(np.concatenate(unsorted)) if unsorted else ():
        own = ordered[segment == s]
        _, kind, times = np.unique(rows[own], axis=0, return_inverse=True, return_counts=True)
        hit[number(own[times[kind.reshape(-1)] > 1])] = True
    return hit


def cores(bodies: DataFrame, length: int) -> DataFrame:
    """(key, rid, at, step): for each step of distances in which a fragment has windows, the bytes that all such windows hold, as one hash with the anchor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            body, off = flat(batch.column(3))
            at = batch.column(2).to_numpy()
            ahead, windows = (at >> 8) & 255, at & 255
            low, high = (ahead - windows + 1) // SPAN, ahead // SPAN
            step = ranges(low, high - low + 1)
            owner = np.repeat(np.arange(len(at)), high - low + 1)
            place = off[owner] + ahead[owner]
            anchor = batch.column(0).to_numpy().view(np.uint64)[owner]
            key = mix(between(prefix(BYTE_CODES[body]), place - step * SPAN, place + length - (step + 1) * SPAN + 1) ^ mix(anchor + step.astype(np.uint64)))
            index = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1).take(index), batch.column(2).take(index), pa.array(step.astype(np.int32))], ["key", "rid", "at", "step"])

    return bodies.select("anchor", "rid", "at", "body").mapInArrow(run, "key long, rid long, at long, step int")


def window_rows(parts: DataFrame, length: int) -> DataFrame:
    """(w1, w2, rid, at, k) of the windows of each fragment's step: both halves of a digest of a window's bytes, and its number in the fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body", 1 << 18):
            body, off = flat(batch.column(3))
            at, step = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            windows = at & 255
            owner = np.repeat(np.arange(len(at)), windows)
            k = ranges(np.zeros(len(at), np.int64), windows)
            chosen = (((at >> 8) & 255)[owner] - k) // SPAN == step[owner]
            owner, k = owner[chosen], k[chosen]
            start = off[owner] + k
            hashes = digests(body.tobytes(), start, start + length, spaced=False)
            yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), batch.column(0).take(pa.array(owner)), pa.array(at[owner]), pa.array(k.astype(np.int32))], ["w1", "w2", "rid", "at", "k"])

    return parts.select("rid", "at", "step", "body").mapInArrow(run, "w1 long, w2 long, rid long, at long, k int")


def repeated_runs(bodies: DataFrame, length: int = LENGTH, most: int = MOST, most_of_core: int = MOST_OF_CORE) -> DataFrame:
    """(rid, at, lo, hi): runs of windows whose bytes another fragment has too. `bodies` has anchor, rid, at and body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 8000):
            hit = repeated_windows(table, length)
            windows = table.column("at").to_numpy() & 255
            first = np.cumsum(windows) - windows
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            # A run never crosses two fragments: cut it where one begins.
            begin = np.zeros(len(hit) + 1, bool)
            begin[first] = True
            inner = np.flatnonzero(begin[1:-1] & hit[1:] & hit[:-1]) + 1 if len(hit) > 1 else np.zeros(0, np.int64)
            lo = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
            hi = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
            owner = np.searchsorted(first, lo, side="right") - 1
            index = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [table.column("rid").combine_chunks().take(index), table.column("at").combine_chunks().take(index), pa.array((lo - first[owner]).astype(np.int32)), pa.array((hi - first[owner]).astype(np.int32))],
                ["rid", "at", "lo", "hi"],
            )

    def sort(parts: DataFrame) -> DataFrame:
        parts = parts.select("key", "step", "rid", "at", "body").repartition("key").sortWithinPartitions("key")
        return parts.mapInArrow(run, "rid long, at long, lo int, hi int")

    many = shared_keys(bodies, ["anchor"]).where(F.col("times") > most)
    whole = F.lit(-1).alias("step")
    found = sort(bodies.join(many, "anchor", "left_anti").select(F.col("anchor").alias("key"), whole, "rid", "at", "body"))
    if many.isEmpty():
        return found
    large = written(bodies.join(many.select("anchor"), "anchor"), "repeats-large")
    held = cores(large, length)
    parts = written(held.join(shared_keys(held, ["key"]), "key"), "repeats-cores")
    small, rest = (parts.where(c).join(large.select("rid", "at", "body"), ["rid", "at"]) for c in (F.col("times") <= most_of_core, F.col("times") > most_of_core))
    return found.unionByName(sort(small)).unionByName(equal_windows(window_rows(rest, length), keep_first=False))


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, most_of_core: int = MOST_OF_CORE) -> DataFrame:
    """(rid, spans): byte ranges, not merged, covered by strings of `length` bytes that also start elsewhere. Needs rid and text."""
    return covered(docs, Kind(length, gram), lambda bodies: repeated_runs(bodies, length, most, most_of_core), keep_first=False)


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return docs.join(spans, "rid", "left")


def _span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, starts and ends of a column of span lists, null as empty."""
    size = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    rows = column.flatten()
    return np.concatenate([[0], np.cumsum(size)]), rows.field("start").to_numpy(), rows.field("end").to_numpy()


def report(docs: DataFrame, most: int = MOST, most_of_core: int = MOST_OF_CORE) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay).

    Null and empty texts have no bytes and the digest of nothing; a repeated row
    counts as a document of its own, so both lose what they share; rows of equal
    or null doc_id are kept apart; an empty table gives none; other columns are
    left out, whatever their names. A text of any length is read whole, in one
    task, with some dozens of bytes of memory a byte.
    """
    keyed = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            body, off = flat(batch.column(1))
            at, starts, ends = _span_arrays(batch.column(2))
            removed, spans, digest = [], [], []
            for i in range(batch.num_rows):
                text = body[off[i] : off[i + 1]]
                if at[i] == at[i + 1]:
                    removed.append(0)
                    spans.append(0)
                    digest.append(hashlib.sha256(text.tobytes()).hexdigest())
                    continue
                gone = marked(len(text), starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_spans(keyed, removed_spans(keyed, most=most, most_of_core=most_of_core)).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
