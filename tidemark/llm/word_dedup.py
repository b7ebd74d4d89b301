"""Substring dedup over words by level-wise doubling.

A window of 20 words that also starts earlier is removed. The search goes by
lengths that double, each level over the table of all candidates: windows of 5
words that occur once can't be part of a repeat and drop out (those are the
anchors of repeats.py); the repeated ones alone are extended to 10 words around
them, those repeated again to 20, until the full length is reached or no
candidate survives. A level is a count by hash that combines before its shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import NOT_SPACE, between, flat, mix, prefix, ranges, slices, word_hashes, words
from .repeats import Kind, covered, digests, equal_windows, marked, shared_keys
from .store import with_row_id, written
from .suffix_dedup import _span_arrays

WINDOW = 20
SHORTEST = 5


def _places(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """Of a batch of (anchor, rid, at, body, alive): word starts and ends, bytes, and of each living window its fragment, number, first word and anchor's word."""
    body, off = flat(batch.column(3))
    at, alive = batch.column(2).to_numpy(), batch.column(4).to_numpy()
    starts, ends, first = words(body, off, NOT_SPACE)
    windows = at & 255
    owner = np.repeat(np.arange(len(at)), windows)
    k = ranges(np.zeros(len(at), np.int64), windows)
    lives = (alive[owner] >> k) & 1 == 1
    owner, k = owner[lives], k[lives]
    return body, starts, ends, owner, k, first[owner] + k, first[owner] + ((at >> 8) & 255)[owner]


def extended(alive: DataFrame, window: int, length: int) -> DataFrame:
    """(key, rid, at, bits): the stretches of `length` words around the anchors of living windows, one hash each with the anchor's,
    and the windows that hold each as bits. A stretch goes as far right as the window reaches, the rest to its left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            body, starts, ends, owner, k, begin, gram = _places(batch, window)
            if not len(owner):
                continue
            start = np.minimum(gram, begin + window - length)
            # Windows of one fragment and stretch stand in a row.
            edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1])]))
            bits = np.bitwise_or.reduceat(np.int64(1) << k, edge)
            owner, start, gram = owner[edge], start[edge], gram[edge]
            anchor = batch.column(0).to_numpy().view(np.uint64)[owner]
            key = mix(between(prefix(word_hashes(body, starts, ends)), start, start + length) ^ mix(anchor + (gram - start).astype(np.uint64)))
            index = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1).take(index), batch.column(2).take(index), pa.array(bits)], ["key", "rid", "at", "bits"])

    return alive.select("anchor", "rid", "at", "body", "alive").mapInArrow(run, "key long, rid long, at long, bits long")


def window_rows(alive: DataFrame, window: int) -> DataFrame:
    """(w1, w2, rid, at, k) of living windows: both halves of a digest of the words, and the window's number in its fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            body, starts, ends, owner, k, begin, _ = _places(batch, window)
            # The texts of fragments are words joined by one blank.
            hashes = digests(body.tobytes(), starts[begin], ends[begin + window - 1], spaced=False)
            index = pa.array(owner)
            yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), batch.column(1).take(index), batch.column(2).take(index), pa.array(k.astype(np.int32))], ["w1", "w2", "rid", "at", "k"])

    return alive.select("anchor", "rid", "at", "body", "alive").mapInArrow(run, "w1 long, w2 long, rid long, at long, k int")


def repeated_runs(bodies: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(rid, at, lo, hi): windows whose words start at an earlier place too. `bodies` has anchor, rid, at and body."""
    alive = bodies.withColumn("alive", F.expr("shiftleft(1L, cast(at & 255 as int)) - 1"))
    length = 2 * shortest
    while length < window:
        held = extended(alive, window, length)
        again = held.join(shared_keys(held, ["key"]), "key").groupBy("rid", "at").agg(F.bit_or("bits").alias("alive"))
        alive = written(bodies.join(again, ["rid", "at"]), "repeats-alive")
        length *= 2
    return equal_windows(window_rows(alive, window), keep_first=True)


def removed_spans(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """(rid, spans): ranges of words, not merged, covered by windows that also start earlier. Needs rid and text."""
    return covered(docs, Kind(window, shortest, words=True), lambda bodies: repeated_runs(bodies, window, shortest), keep_first=True)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one blank).

    Null and empty texts have no words and the digest of nothing. The earliest
    place is by doc_id (null first), then text, then start: of repeated rows the
    first keeps its words. An empty table gives none; other columns are left out,
    whatever their names. A text of any length is read whole, in one task.
    """
    keyed = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            body, off = flat(batch.column(1))
            raw = body.tobytes()
            at, starts, ends = _span_arrays(batch.column(2))
            n, removed, digest = [], [], []
            for i in range(batch.num_rows):
                ws = raw[off[i] : off[i + 1]].split()
                n.append(len(ws))
                gone = 0
                if at[i] != at[i + 1]:
                    mask = marked(len(ws), starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])
                    gone = int(mask.sum())
                    ws = [w for w, m in zip(ws, mask.tolist(), strict=True) if not m]
                removed.append(gone)
                digest.append(hashlib.sha256(b" ".join(ws)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = keyed.join(removed_spans(keyed), "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
