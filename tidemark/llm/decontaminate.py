"""Benchmark decontamination with a generalised suffix automaton.

One automaton over the words of all benchmark items holds every stretch of
every item. The words of a document are streamed through it; after each word its
state gives the longest stretch of any item that ends there. Where that length
reaches a window (10 words, or a whole shorter item), the window's words are hit
and the items that hold it are known from the state.

Only runs of words whose neighbouring pairs all occur in some item are streamed:
no window can lie outside such a run. The runs are found by array operations on
the batch, so ordinary text costs no step of the automaton.

The automaton is broadcast. Its size is bound: items are taken in shares of at
most `share_bytes` of text, each with an automaton of its own, built and
broadcast one after the other. A scan of the documents streams each text through
up to `SHARES_AT_ONCE` of them; more shares take more scans. Every scan sees the
whole texts; spans of all shares are merged before anything is judged or cut.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ALNUM, flat, slices, word_hashes, words
from .store import free, with_row_id, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
WINDOW = 10
#: Bytes of items in one automaton, and automata that a task holds at once.
SHARE_BYTES, SHARES_AT_ONCE = 1 << 20, 4
#: Stands for the id of an item that has none: its windows hit, and it is named nowhere.
NO_ID = -(1 << 63)


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of every state's windows."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: Items that hold the state's strings: filled for states that hold a string of `window` words.
        held: dict[int, set[int]] = {}
        #: Whole short items by the state that holds them and their length.
        self.short: dict[int, dict[int, set[int]]] = {}
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        #: All transitions in one table, by state and word: a table for each state would take several times the room.
        self.base = 1 + max((w for _, seq in items for w in seq), default=0)
        self.edges = {state * self.base + w: to for state, out in enumerate(self.next) for w, to in out.items()}
        self.next = []
        self.link, self.length = array("l", self.link), array("l", self.length)
        for item, seq in items:
            if len(seq) < window:
                state = 0
                for w in seq:
                    state = self.edges[state * self.base + w]
                if seq:
                    self.short.setdefault(state, {}).setdefault(len(seq), set()).add(item)
                continue
            state = length = 0
            for w in seq:
                state, length = self.step(state, length, w)
                state = self.window_state(state)
                length = min(length, self.length[state])
                if length >= window:
                    held.setdefault(state, set()).add(item)
        self.held = {s: tuple(sorted(x)) for s, x in held.items()}

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The state and length of the longest stretch of any item that ends with this word; a negative word is in none."""
        if w < 0:
            return 0, 0
        to = self.edges.get(state * self.base + w)
        while to is None and state:
            state = self.link[state]
            matched = self.length[state]
            to = self.edges.get(state * self.base + w)
        return (0, 0) if to is None else (to, matched + 1)

    def window_state(self, state: int) -> int:
        """The state that holds the last `window` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, seq: list[int]) -> Iterator[tuple[int, int, Iterable[int]]]:
        """(start, end, items) of each window's occurrence in the sequence, by its last word."""
        state = matched = 0
        for end, w in enumerate(seq, 1):
            state, matched = self.step(state, matched, w)
            # Only the last `window` words matter: to go on from the state that holds them bounds all walks along links by the words read.
            state = self.window_state(state)
            matched = min(matched, self.length[state])
            if matched >= self.window and (items := self.held.get(state)):
                yield end - self.window, end, items
            if self.short:
                s = state
                while s > 0:
                    for size, items in self.short.get(s, {}).items():
                        if size <= matched:
                            yield end - size, end, items
                    s = self.link[s]


class Matcher:
    """What executors get: the automaton, the hashes of its words, and those of neighbouring pairs."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        split = [(i, WORD.findall((t or "").translate(ASCII_LOWER))) for i, t in items]
        names = sorted({w for _, ws in split for w in ws})
        column = pa.array(names, pa.string())
        body, off = flat(column)
        codes = word_hashes(body, off[:-1], off[1:]) if names else np.zeros(0, np.uint64)
        order = np.argsort(codes)
        self.hashes = codes[order]
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        ids = {w: int(number[k]) for k, w in enumerate(names)}
        sequences = [(i, [ids[w] for w in ws]) for i, ws in split]
        self.names = [names[k].encode() for k in order]
        pairs = {(a, b) for _, s in sequences for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.sort(np.array([a * len(names) + b for a, b in pairs], np.int64))
        #: Words that are an item on their own need no neighbour.
        self.single = np.zeros(len(names), bool)
        for _, s in sequences:
            if len(s) == 1 < window or window == 1:
                self.single[s] = True
        self.least = min([window, *(len(s) for _, s in sequences if s)])
        self.automaton = Automaton(sequences, window)

    def runs(self, body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Word offsets by text, vocabulary numbers of all words (-1: in no item), and runs that may hold a window."""
        starts, ends, first = words(body, off, ALNUM)
        number = np.full(len(starts), -1, np.int64)
        if len(self.hashes) and len(starts):
            h = word_hashes(body, starts, ends, lower=True)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = self.hashes[at] == h
            number[known] = at[known]
        joined = np.zeros(len(number) + 1, bool)  # word k goes on from word k - 1
        if len(number) > 1 and len(self.pairs):
            both = (number[1:] >= 0) & (number[:-1] >= 0)
            key = number[:-1] * len(self.hashes) + number[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[1:-1] = both & (self.pairs[at] == key)
        joined[first] = False
        begin = np.flatnonzero(~joined[:-1])
        end = np.append(begin[1:], len(number)) if len(begin) else begin
        size = end - begin
        keep = size >= max(self.least, 2)
        if self.least == 1:
            keep |= np.logical_or.reduceat((number >= 0) & self.single[number], begin) if len(begin) else keep
        runs = list(zip(begin[keep].tolist(), end[keep].tolist(), strict=True))
        for a, b in runs:
            # Equal hashes alone make no equal words.
            for k in range(a, b):
                if number[k] >= 0 and body[starts[k] : ends[k]].tobytes().lower() != self.names[number[k]]:
                    number[k] = -1
        return first, number, runs


Found = dict[int, tuple[list[tuple[int, int]], set[int]]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scanned(matchers: list[Matcher], text: pa.Array) -> tuple[np.ndarray, Found]:
    """Number of words of each text, and for texts with hits their merged spans of words and the items."""
    body, off = flat(text)
    found: Found = {}
    first = np.zeros(len(text) + 1, np.int64)
    for matcher in matchers:
        first, number, runs = matcher.runs(body, off)
        for a, b in runs:
            doc = int(np.searchsorted(first, a, side="right")) - 1
            base = a - int(first[doc])
            for s, e, items in matcher.automaton.scan(number[a:b].tolist()):
                spans, ids = found.setdefault(doc, ([], set()))
                if spans and s + base <= spans[-1][1] and s + base >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], e + base))
                else:
                    spans.append((s + base, e + base))
                ids.update(items)
    return np.diff(first), {doc: (merged(spans), ids) for doc, (spans, ids) in found.items()}


def matchers(items: DataFrame, window: int, share_bytes: int) -> list[list]:
    """Broadcast matchers by scan, each over a share of the items of at most about `share_bytes` of text. Items of null id take part under NO_ID."""
    spark = items.sparkSession
    part = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.col("text").cast("string").alias("text"))
    size = part.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    shares = max(1, -(-int(size["bytes"] + 16 * size["rows"]) // share_bytes))
    out = []
    for k in range(shares):
        own = part if shares == 1 else part.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shares)) == k)
        # One share's items at a time come to the driver; the broadcast keeps them in a file.
        out.append(spark.sparkContext.broadcast(Matcher(sorted((r["item_id"], r["text"] or "") for r in own.collect()), window)))
    return [out[k : k + SHARES_AT_ONCE] for k in range(0, shares, SHARES_AT_ONCE)]


SPANS = "array<struct<start:long,end:long>>"


def hits(docs: DataFrame, scans: list[list]) -> DataFrame:
    """One row a document row: rid, doc_id, n_words, spans (maximal hit runs of words, [start, end)), items (ids with windows in it).

    Needs rid, doc_id and text; rid must be unique where there is more than one scan. Items of null or wordless text have no window.
    """
    rows = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for group in scans:

        def scan(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                n_words, found = scanned([m.value for m in group], batch.column(2))
                none: tuple[list, set] = ([], set())
                spans = [[{"start": s, "end": e} for s, e in found.get(i, none)[0]] for i in range(batch.num_rows)]
                ids = [sorted(found.get(i, none)[1] - {NO_ID}) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(ids, pa.list_(pa.int64()))], ["rid", "doc_id", "n_words", "spans", "items"])

        part = rows.mapInArrow(scan, f"rid long, doc_id long, n_words long, spans {SPANS}, items array<long>")
        out = part if out is None else out.unionByName(part)
    if len(scans) == 1:
        return out
    together = out.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    join = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    return together.select("rid", "doc_id", "n_words", join.alias("spans"), "items")


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; repeated rows give a row each; a null
    doc_id stays null; repeated items count once by id; windows of items of null id
    are hits as any other, but name no item, so a document can be contaminated
    with n_items 0; an empty benchmark hits nothing; an empty table gives no rows. Where items share a window, all of them
    count. A text of any length is streamed whole, in one task. Other columns are
    left out, whatever their names.
    """
    scans = matchers(items, window, share_bytes)
    rows = docs.select("doc_id", "text")
    found = hits(rows.withColumn("rid", F.lit(0).cast("long")) if len(scans) == 1 else with_row_id(rows), scans)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what parts each from the word before."""
    at = [m.span() for m in WORD.finditer(text.translate(ASCII_LOWER))]
    pieces, last = [], 0
    for a, b in spans:
        pieces.append(text[last : at[a - 1][1] if a else at[a][0]])
        last = at[b - 1][1]
    return "".join([*pieces, text[last:]])


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_hit_words: int = 50, max_coverage: float = 0.2, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """The documents with hit spans cut out; a document goes where more than `max_hit_words` words or more than
    `max_coverage` of its words are hit. Texts without a hit stay as they are, null and empty texts too, and equal rows
    fare alike; items of null id are items. All columns stay, whatever their names; an empty table gives none; a text of any length is streamed whole.

    Spans of all items are merged before a text is judged and cut, so the result is that of one automaton over all items.
    """
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    scans = matchers(items, window, share_bytes)
    if len(scans) > 1:
        rid, mark = free(names, "rid"), free(names, "hit_spans")
        keyed = with_row_id(docs, name=rid)
        spans = hits(keyed.select(F.col(rid).alias("rid"), "doc_id", "text"), scans).where(F.size("spans") > 0)
        docs = keyed.join(written(spans.select(F.col("rid").alias(rid), F.col("spans").alias(mark)), "contaminated"), rid, "left").select(*names, mark)

    def spans_of(batch: pa.RecordBatch) -> dict[int, list[tuple[int, int]]]:
        if len(scans) == 1:
            return {i: spans for i, (spans, _) in scanned([m.value for m in scans[0]], batch.column(at))[1].items()}
        return {i: [(x["start"], x["end"]) for x in spans] for i, spans in enumerate(batch.column(len(names)).to_pylist()) if spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [batch.column(j) for j in range(len(names))]
            keep = np.ones(batch.num_rows, bool)
            spans = spans_of(batch)
            if spans:
                texts = own[at].to_pylist()
                for i, hit in spans.items():
                    n, n_words = sum(e - s for s, e in hit), sum(1 for _ in WORD.finditer(texts[i].translate(ASCII_LOWER)))
                    if n > max_hit_words or n > max_coverage * n_words:
                        keep[i] = False
                    else:
                        texts[i] = cut(texts[i], hit)
                own[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(own, names).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
