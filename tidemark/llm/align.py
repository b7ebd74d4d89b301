"""Alignment of two tokenizers over one text, by a sweep over the places where their tokens end.

Both encoders give the ends of their tokens as events. Events of both sides are
put together, dealt by document, sorted by offset within partitions and streamed
through a machine that holds the group still open, the running digest and a
bounded number of linked pairs. Where tokens of both sides end at the same byte, the open
group closes: it is emitted with a link for each pair of an A and a B token in it.

An event row holds a run of tokens of one side whose ends lie in one stretch of
`STRETCH` bytes: their ids, and where the first of them starts; the ends follow from
the lengths of the tokens' bytes.

How many documents hold a pair linked is counted over the corpus. Pairs that
hold more than one part in `FREQUENT` of all (document, pair) entries are fewer than
`FREQUENT`, so they go to every task and are looked up there: no frequent
pair is ever a key of a join. The others are joined by pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .columns import ranges, slices
from .store import with_row_id, written

STRETCH = 1 << 15
FREQUENT = 1 << 17
#: Distinct linked pairs that the machine holds for one document before it hands them on.
LINKS_HELD = 1 << 20
#: Links of a group beyond which its distinct ids are multiplied and not its tokens.
LARGE_GROUP = 1 << 12
LONG_PIECE = 1000
LONG = re.compile(rf"\S{{{LONG_PIECE}}}|\s{{{LONG_PIECE}}}")
ID_BITS = 21
COUNT_ROWS = 1 << 20

EVENTS = "rid long, doc_id long, stretch long, side byte, start long, ids binary"
DOCS = "rid long, doc_id long, part int, last boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, n binary"


def packed(values: np.ndarray, width: int) -> bytes:
    """Integers as bytes, all lowest bytes first: high bytes are mostly zeros and compress to nothing."""
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


class ByteSide:
    """Encoder A: a byte-level BPE file; strings of special tokens are plain text.

    Where ids are in the order of the merges, they are the ranks that tiktoken merges by, which is several times as fast; texts with a
    stretch of `LONG_PIECE` characters without a border, which it takes quadratic time for, and other files go to this library's own encoder.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = bpe.byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special and all(c in alphabet for c in t)}
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        merged = [ranks[bytes(alphabet[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        in_order = all(x < y for x, y in zip(merged, merged[1:], strict=False)) and len(merged) + 256 == len(ranks)
        self.fast = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain and in_order else None
        self.path = path

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if self.fast is None or (len(t) >= LONG_PIECE and LONG.search(t)):
                out.append(np.frombuffer(bpe.codec(self.path).encode_plain(" " + t), "<u4").astype(np.int64))
            else:
                out.append(np.array(self.fast.encode_ordinary(" " + t), np.int64))
        return out


class PieceSide:
    """Encoder B: a sentencepiece model, which puts a blank before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes_of = [bytes([int(t[3:5], 16)]) if p.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(pieces)]
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, or None where their bytes joined are not a blank and the text."""
        found = self.processor.encode(texts, num_threads=1)
        return [np.array(ids, np.int64) if b"".join([self.bytes_of[i] for i in ids]) == (" " + t).encode() else None for ids, t in zip(found, texts, strict=True)]


@functools.lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a_path), PieceSide(b_path)


def events(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """EVENTS of (rid, doc_id, text). A text without tokens has one row without ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        for batch in slices(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            out: list[tuple] = []
            for rid, doc, text, of_a, of_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, a.encode(texts), b.encode(texts), strict=True):
                if not text or of_b is None:
                    out.append((rid, doc, 0, 0, 0, b""))
                    continue
                for side, ids, lengths in ((0, of_a, a.lengths), (1, of_b, b.lengths)):
                    ends = np.cumsum(lengths[ids])
                    cuts = np.flatnonzero(np.diff((ends - 1) // STRETCH)) + 1
                    for s, e in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                        out.append((rid, doc, int(ends[s] - 1) // STRETCH, side, int(ends[s - 1]) if s else 0, packed(ids[s:e], 4)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["rid", "doc_id", "stretch", "side", "start", "ids"])

    return rows.select("rid", "doc_id", "text").mapInArrow(run, EVENTS)


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(kinds), np.int64)
    np.add.at(out, at, n)
    return kinds, out


def links_of(ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, a, b) in one integer, sorted, and how often each is linked, from tokens and their groups' numbers; doc: of each group."""
    n = len(doc)
    ca, cb = np.bincount(group[0], minlength=n), np.bincount(group[1], minlength=n)
    large = np.flatnonzero(ca * cb > LARGE_GROUP)
    first_b = np.cumsum(cb) - cb
    per = cb[group[0]]
    if len(large):
        per = np.where(np.isin(group[0], large), 0, per)
    x = np.repeat(np.arange(len(ids[0])), per)
    y = ranges(first_b[group[0]], per)
    key = (doc[group[0][x]] << (2 * ID_BITS)) | (ids[0][x] << ID_BITS) | ids[1][y]
    kinds, n_of = np.unique(key, return_counts=True)
    if not len(large):
        return kinds, n_of.astype(np.int64)
    keys, counts = [kinds], [n_of.astype(np.int64)]
    for g in large:
        a, na = np.unique(ids[0][group[0] == g], return_counts=True)
        b, nb = np.unique(ids[1][group[1] == g], return_counts=True)
        keys.append(((doc[g] << (2 * ID_BITS)) | (a[:, None] << ID_BITS) | b[None, :]).ravel())
        counts.append((na[:, None] * nb[None, :]).ravel())
    return _summed(np.concatenate(keys), np.concatenate(counts))


class Machine:
    """Takes event rows in order of (document, stretch) and gives rows of DOCS. Its state: the tokens of the open group, the open
    document's counts and digest, and at most `links_held` of its linked pairs."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], links_held: int) -> None:
        self.lengths, self.links_held = lengths, links_held
        # Decimal ids with the sign that follows: within a group, and at the end of its side.
        self.words = tuple(np.array([f"{i}{sep}".encode() for i in range(len(lengths[side])) for sep in "," + "|;"[side]], dtype=object) for side in (0, 1))
        self.rid: int | None = None

    def _open(self, rid: int, doc: int | None) -> None:
        none = np.zeros(0, np.int64)
        self.rid, self.doc, self.part, self.counts, self.digest = rid, doc, 0, np.zeros(4, np.int64), hashlib.sha256()
        self.ids, self.ends = [none, none], [none, none]
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def _row(self, last: bool) -> tuple:
        pairs, n = _summed(np.concatenate([p for p, _ in self.pairs]), np.concatenate([c for _, c in self.pairs])) if len(self.pairs) > 1 else self.pairs[0] if self.pairs else (np.zeros(0, np.int64),) * 2
        a = pairs >> ID_BITS
        stats = (*(int(c) for c in self.counts), self.digest.hexdigest() if self.counts[2] else "") if last else (None,) * 5
        row = (self.rid, self.doc, self.part, last, *stats, packed(np.diff(a, prepend=0), 4), packed(pairs & ((1 << ID_BITS) - 1), 4), packed(n, 8))
        self.part, self.pairs = self.part + 1, []
        return row

    def close(self) -> Iterator[tuple]:
        if self.rid is not None:
            yield self._row(True)
        self.rid = None

    def take(self, rids: list[int], docs: list[int | None], sides_: list[int], starts: list[int], ids: list[bytes]) -> Iterator[tuple]:
        # Documents of these rows in order; the open one is number 0 if it goes on.
        order: list[tuple[int, int | None]] = [] if self.rid is None else [(self.rid, self.doc)]
        if self.rid is None:
            self._open(rids[0], docs[0])
            order = [(rids[0], docs[0])]
        of, ends = ([self.ids[0]], [self.ids[1]]), ([self.ends[0]], [self.ends[1]])
        for rid, doc, side, start, raw in zip(rids, docs, sides_, starts, ids, strict=True):
            if rid != order[-1][0]:
                order.append((rid, doc))
            if raw:
                t = unpacked(raw, 4)
                of[side].append(t)
                ends[side].append(((len(order) - 1) << 40) + start + np.cumsum(self.lengths[side][t]))
        tokens, ends = [np.concatenate(x) for x in of], [np.concatenate(x) for x in ends]
        shared = np.intersect1d(ends[0], ends[1], assume_unique=True)
        doc_of = shared >> 40
        group = tuple(np.searchsorted(shared, e) for e in ends)
        closed = [int(np.searchsorted(g, len(shared))) for g in group]
        rest = [(t[c:], e[c:]) for t, e, c in zip(tokens, ends, closed, strict=True)]
        tokens, group = tuple(t[:c] for t, c in zip(tokens, closed, strict=True)), tuple(g[:c] for g, c in zip(group, closed, strict=True))
        n_of = [np.bincount(g, minlength=len(shared)) for g in group]
        # Both sides in the order of groups, A before B, as decimal words.
        last = [np.append(np.diff(g) > 0, True)[: len(g)] for g in group]
        up_to = [np.cumsum(n) for n in n_of]
        merged = np.empty(sum(closed), dtype=object)
        merged[np.arange(closed[0]) + (up_to[1] - n_of[1])[group[0]]] = self.words[0][2 * tokens[0] + last[0]]
        merged[np.arange(closed[1]) + up_to[0][group[1]]] = self.words[1][2 * tokens[1] + last[1]]
        merged = merged.tolist()
        links, times = links_of(tokens, group, doc_of)
        k = np.arange(len(order) + 1)
        at_group, at_link = np.searchsorted(doc_of, k), np.searchsorted(links >> (2 * ID_BITS), k)
        ahead = [np.concatenate([[0], u]) for u in up_to]
        product = np.concatenate([[0], np.cumsum(n_of[0] * n_of[1])])
        for d, (rid, doc) in enumerate(order):
            if d:
                yield from self.close()
                self._open(rid, doc)
            g0, g1 = at_group[d], at_group[d + 1]
            if g1 > g0:
                a, b = (ahead[s][g1] - ahead[s][g0] for s in (0, 1))
                text = b"".join(merged[ahead[0][g0] + ahead[1][g0] : ahead[0][g1] + ahead[1][g1]])
                self.digest.update((b";" if self.counts[2] else b"") + text[:-1])
                self.counts += np.array([a, b, g1 - g0, product[g1] - product[g0]])
                self.pairs.append((links[at_link[d] : at_link[d + 1]] & ((1 << (2 * ID_BITS)) - 1), times[at_link[d] : at_link[d + 1]]))
                if len(self.pairs) > 1 and sum(len(p) for p, _ in self.pairs) > self.links_held:
                    self.pairs = [_summed(np.concatenate([p for p, _ in self.pairs]), np.concatenate([c for _, c in self.pairs]))]
                    if len(self.pairs[0][0]) > self.links_held:
                        yield self._row(False)
        # What is open belongs to the last document: any other ends where both sides end.
        base = (len(order) - 1) << 40
        self.ids, self.ends = [t for t, _ in rest], [e - base for _, e in rest]


def swept(events_: DataFrame, a_path: str, b_path: str, links_held: int = LINKS_HELD) -> DataFrame:
    """DOCS: one row a document with its counts and linked pairs; a document of more pairs than the machine holds has rows before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        machine = Machine((a.lengths, b.lengths), links_held)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 3]
        names = [x.split()[0] for x in DOCS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in slices(batches, "ids", 1 << 20):
            rid, doc, _, side, start, ids = (c.to_pylist() for c in batch.columns)
            rows = list(machine.take(rid, doc, side, start, ids))
            if rows:
                yield batch_of(rows)
        rows = list(machine.close())
        if rows:
            yield batch_of(rows)

    return events_.repartition("rid").sortWithinPartitions("rid", "stretch", "side").mapInArrow(run, DOCS)


def _pairs_in(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of rows (rid, a, b, n): ids, pairs and times of each."""
    pairs, times = [], []
    for a, b, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        pairs.append((np.cumsum(unpacked(a, 4)) << ID_BITS) | unpacked(b, 4))
        times.append(unpacked(n, 8))
    return batch.column(0).to_numpy(), pairs, times


def _counted(whole: DataFrame) -> DataFrame:
    """(pair, docs): partial counts of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            pairs, docs = _summed(np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held]))
            held[:] = [(pairs, docs)]
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(docs)], ["pair", "docs"])

        for batch in slices(batches, "b", 4 << 20):
            pairs = np.concatenate(_pairs_in(batch)[1])
            held.append(tuple(np.unique(pairs, return_counts=True)))
            if sum(len(p) for p, _ in held) > COUNT_ROWS and out().num_rows > COUNT_ROWS // 2:
                yield out()
                held.clear()
        if held:
            yield out()

    return whole.select("rid", "a", "b", "n").mapInArrow(run, "pair long, docs long")


def _exploded(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b", 4 << 20):
            rids, pairs, times = _pairs_in(batch)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rids, [len(p) for p in pairs])), pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times))], ["rid", "pair", "n"])

    return parts.select("rid", "a", "b", "n").mapInArrow(run, "rid long, pair long, n long")


def pair_counts(swept_: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents each linked pair is, and whether that is the most among the pairs of its A id. Written."""
    split = _exploded(swept_.where("part > 0 OR NOT last")).select("rid", "pair").distinct().select("pair", F.lit(1).cast("long").alias("docs"))
    counts = _counted(swept_.where("part = 0 AND last")).unionByName(split).groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(counts, "align-counts")
    a = F.shiftright("pair", ID_BITS).alias("a")
    most = counts.groupBy(a).agg(F.max("docs").alias("most"))
    return written(counts.withColumn("a", a).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "align-pairs", counts)


def _looked_up(whole: DataFrame, frequent: list[tuple[int, int, bool]]) -> DataFrame:
    """Of each document one row with the sums over its frequent pairs, and a row for each other pair, to be joined."""
    known = np.array(sorted(frequent), np.int64).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, docs, best = known[:, 0].copy(), known[:, 1].copy(), known[:, 2].copy()
        for batch in slices(batches, "b", 4 << 20):
            rids, pairs, times = _pairs_in(batch)
            doc = np.repeat(np.arange(len(rids)), [len(p) for p in pairs])
            pair, n = np.concatenate(pairs), np.concatenate(times)
            at = np.minimum(np.searchsorted(table, pair), max(len(table) - 1, 0))
            hit = table[at] == pair if len(table) else np.zeros(len(pair), bool)
            n_best, count_sum = np.zeros(len(rids), np.int64), np.zeros(len(rids), np.int64)
            np.add.at(n_best, doc[hit], n[hit] * best[at[hit]])
            np.add.at(count_sum, doc[hit], n[hit] * docs[at[hit]])
            m, zeros = ~hit, np.zeros(len(rids), np.int64)
            none = np.zeros(int(m.sum()), np.int64)
            # A document's own row gets a key that no pair has, so that these rows are spread.
            columns = [np.concatenate([rids, rids[doc[m]]]), np.concatenate([-1 - (rids & ((1 << 60) - 1)), pair[m]]), np.concatenate([zeros, n[m]]), np.concatenate([n_best, none]), np.concatenate([count_sum, none])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "pair", "n", "n_best", "count_sum"])

    return whole.select("rid", "a", "b", "n").mapInArrow(run, "rid long, pair long, n long, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", links_held: int = LINKS_HELD, frequent: int = FREQUENT) -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that B's pieces don't spell again (a text with U+2581), have zeros and an empty digest. Rows that
    repeat are documents of their own, in the counts as well; a null id stays null; other columns are left out, whatever their
    names; an empty table gives none. A text of any length is encoded whole; the sweep's memory doesn't grow with it.
    """
    rows = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    table = written(swept(events(rows, a_path, b_path), a_path, b_path, links_held), "align-docs")
    pairs = pair_counts(table)
    entries = pairs.agg(F.sum("docs")).first()[0] or 0
    top = [(r["pair"], r["docs"], r["best"]) for r in pairs.where(F.col("docs") * frequent > entries).collect()]
    split = _exploded(table.where("part > 0 OR NOT last")).groupBy("rid", "pair").agg(F.sum("n").alias("n")).select("rid", "pair", "n", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    found = _looked_up(table.where("part = 0 AND last"), top).unionByName(split).join(pairs, "pair", "left")
    sums = found.groupBy("rid").agg(F.sum(F.col("n_best") + F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("count_sum") + F.col("n") * F.coalesce("docs", F.lit(0))).alias("count_sum"))
    stats = table.where("last").select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return stats.join(sums, "rid", "left").select(F.col("doc_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def links(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, a, b, times): which tokens of A and B stand for each other in each document, and how often. Rows of one id are counted
    together; rows of a null id are left out."""
    rows = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL"))
    found = _exploded(swept(events(rows, a_path, b_path), a_path, b_path).withColumn("rid", F.col("doc_id"))).groupBy("rid", "pair").agg(F.sum("n").alias("times"))
    return found.select(F.col("rid").alias(id_column), F.shiftright("pair", ID_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int").alias("b"), "times")
