"""BPE encoding by a backtracking encoder, and decoding by an offset table.

The encoder takes the longest vocabulary entry at the current byte from an
Aho-Corasick automaton, and keeps it if the pair with the token before it is
compatible: BPE over the joined bytes of both would give just these two tokens.
If not, it tries the next shorter entry; where none fits, it takes the last
token back and shortens that one. Each byte is left for good after a bounded
number of tries, so time is linear in the text, and the tokens are exactly those
that merging pairs by rank gives. Whether a pair is compatible is worked out
once from the merge table and kept.

Decoding looks up each id's bytes in one blob by an offset table.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ranges, slices

#: The split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES = 800_000
LONGEST_KEPT = 48
BATCH_BYTES = 2 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: visible Latin-1 as itself, the others from U+0100 up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one tokenizers .json file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("only a byte-level BPE file without normalizer or prefix space can be encoded")
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        special = {a.encode() for a in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.vocab = {t: i for t, i in vocab.items() if t not in special}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        #: (left id, right id) -> rank and merged id.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        #: id -> the pair that it was merged from.
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = vocab[to_bytes(a)], vocab[to_bytes(b)]
            whole = vocab[to_bytes(a) + to_bytes(b)]
            self.merges.setdefault((left, right), (rank, whole))
        for token, i in self.vocab.items():
            if len(token) > 1:
                self._take_apart(token, i)
        self.reachable = {i for t, i in self.vocab.items() if len(t) == 1} | set(self.parts)
        self.longest = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if i in self.reachable:
                self.longest.add_word(token.decode("latin-1"), (len(token), i))
        self.longest.make_automaton()
        #: For each token the next shorter token that it starts with, or -1.
        self.shorter = {i: next((self.vocab[t[:k]] for k in range(len(t) - 1, 0, -1) if self.vocab.get(t[:k], -1) in self.reachable), -1) for t, i in self.vocab.items() if i in self.reachable}
        self.size = {i: len(t) for i, t in self.bytes_of.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(PATTERN)
        self.added = added
        self.added_split = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None
        #: Ids by piece: those met lately, and those of the time before.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        top = max([*self.bytes_of, *added.values()]) + 1
        pieces = [b""] * top
        for i, t in self.bytes_of.items():
            pieces[i] = t
        for a, i in added.items():
            pieces[i] = a.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)

    def _take_apart(self, token: bytes, i: int) -> None:
        """Merges the token's own bytes by rank; only a token that merging reaches can be in an encoding, and its last merge is its pair."""
        ids, last = [self.vocab[token[k : k + 1]] for k in range(len(token))], None
        while len(ids) > 1:
            found = [(self.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
            if not found:
                return
            k = min(found)[1]
            last = (ids[k], ids[k + 1])
            ids[k : k + 2] = [self.merges[last][1]]
        if ids == [i] and last:
            self.parts[i] = last

    def compatible(self, left: int, right: int) -> bool:
        """True if no merge would join bytes across the border of the two tokens before both are whole."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Walk both tokens apart, latest merge first; at each step the pair at the border must not have merged earlier than what was taken apart.
        limit = len(self.merges) + 1
        while True:
            merge = self.merges.get((a, b))
            if merge and merge[0] < limit:
                return False
            pa_, pb = self.parts.get(a), self.parts.get(b)
            ra = self.merges[pa_][0] if pa_ else -1
            rb = self.merges[pb][0] if pb else -1
            if ra < 0 and rb < 0:
                return True
            # Of equal ranks the left one is merged first, so the right one is taken apart first.
            if ra > rb:
                limit, a = ra, pa_[1]
                # A pair at the border merges before a later one on its left only if its rank is lower.
            else:
                limit, b = rb + 1, pb[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token."""
        whole = self.vocab.get(piece)
        if whole is not None and whole in self.reachable:
            return [whole]
        text = piece.decode("latin-1")
        at_start: list[tuple[int, int] | None] = [None] * len(piece)
        for end, (size, i) in self.longest.iter(text):
            start = end - size + 1
            if at_start[start] is None or at_start[start][0] < size:
                at_start[start] = (size, i)
        out: list[int] = []
        pos, n = 0, len(piece)
        dead = bytearray(n + 1)  # ends of prefixes that no valid encoding passes with what is before
        token = at_start[0][1]
        while True:
            end = pos + self.size[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                pos = end
                if pos == n:
                    return out
                token = at_start[pos][1]
                continue
            token = self.shorter[token]
            while token < 0:
                dead[pos] = 1
                last = out.pop()
                pos -= self.size[last]
                token = self.shorter[last]

    def encode_plain(self, text: str) -> bytes:
        if len(self.kept) > KEPT_PIECES // 2:
            self.older, self.kept = self.kept, {}
        kept, older, out = self.kept, self.older, []
        for piece in self.split.findall(text):
            ids = kept.get(piece)
            if ids is None:
                ids = older.get(piece)
                if ids is None:
                    ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= LONGEST_KEPT:
                    kept[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers; an added token's string in the text is that token, as the library has it."""
        if not self.added_split:
            return np.frombuffer(self.encode_plain(text), "<u4")
        parts = self.added_split.split(text)
        return np.frombuffer(b"".join(self.encode_plain(p) if k % 2 == 0 else np.array([self.added[p]], "<u4").tobytes() for k, p in enumerate(parts)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids in a row, found by the offset table."""
        starts = self.offsets[ids]
        return self.blob[ranges(starts, self.offsets[ids.astype(np.int64) + 1] - starts)].tobytes()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _rows(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id") -> DataFrame:
    """One row a document: id and its token ids. Null texts count as empty and have none; repeated rows give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in slices(batches, "text", BATCH_BYTES):
            ids = [c.encode(t or "").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return _rows(docs, id_column).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_column)


def decoded(tokens: DataFrame, tokenizer_path: str, id_column: str = "doc_id") -> DataFrame:
    """The texts of `ids`; null ids give an empty text. Bytes that aren't UTF-8 become U+FFFD, as in the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            texts = [c.decode(np.array(i or [], np.uint32)).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return tokens.select(F.col(id_column).cast("long").alias("id"), "ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each whole text where it is read, and returns digests: id, n_tokens, ids_sha256 (of ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded text in UTF-8). with_ids: also `ids`, the ids themselves in that
    form, four bytes each: a list column of as many numbers costs the JVM several times the encoding.

    Null texts count as empty; an empty text has no tokens and the digest of nothing; repeated rows give a row each;
    a null id stays null; other columns are left out, whatever their names; an empty table gives none. A text of any length
    is encoded whole, in one task.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in slices(batches, "text", BATCH_BYTES):
            ids_sha, text_sha, all_ids = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t or "")
                all_ids.append(ids)
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            sizes = np.array([len(i) for i in all_ids], np.int64)
            columns = [batch.column(0), pa.array(sizes), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                columns.append(pa.array([i.tobytes() for i in all_ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return _rows(docs, id_column).mapInArrow(run, schema).withColumnRenamed("id", id_column)
