"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes. Texts are cut at safe boundaries, where no token
can reach across: with a byte-level pre-tokenizer that is any place between a
character that isn't white space and a blank. Pieces repeat (they are mostly
words), so each worker encodes the pieces that it hasn't met, in one batch, and
keeps their lengths in a table of bounded size.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import slices

BATCH_BYTES = 4 << 20
KEPT_PIECES = 900_000
LONGEST_KEPT = 64
#: Characters of a piece beyond which it is cut further, at places where the pre-tokenizer always parts: before white space after
#: another character, and between letters, digits and other signs (not after an apostrophe, which may begin a contraction).
LONG_PIECE = 2000
CHANGE = regex.compile(r"(?V1)(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


class JsonCounter:
    """Counts for a tokenizers .json file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = spec.get("added_tokens", [])
        #: An added token that holds a blank, or takes the blanks around it, could reach across a cut.
        self.cuts = bool(plain) and not any(" " in a["content"] or a.get("lstrip") or a.get("rstrip") for a in added)
        self.added = [a["content"] for a in added]
        #: Lengths by piece: those met lately, and those of the time before.
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        """The text cut before each blank that follows a character that isn't white space; all but the first start with a blank.

        A piece that is still long is cut where its kind of character changes, unless it holds an added token's string.
        """
        parts = text.split(" ")
        out, carry = [], parts[0]
        for part in parts[1:]:
            if not carry or carry[-1].isspace():
                carry += " " + part
            else:
                out.append(carry)
                carry = " " + part
        out.append(carry)
        if max(map(len, out)) <= LONG_PIECE:
            return out
        fine = []
        for piece in out:
            if len(piece) > LONG_PIECE and not any(a in piece for a in self.added):
                fine.extend(CHANGE.split(piece))
            else:
                fine.append(piece)
        return fine

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return self.encode(texts)
        cut = [self.pieces(t) for t in texts]
        if len(self.kept) > KEPT_PIECES // 2:
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        new = {p for pieces in cut for p in pieces if p not in kept}
        known = new & older.keys()
        kept.update((p, older[p]) for p in known)
        new = list(new - known)
        kept.update(zip(new, self.encode(new), strict=True))
        out = [sum(map(kept.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del kept[p]
        return out


class ModelCounter:
    """Counts for a sentencepiece .model file; it normalises white space, so texts are never cut."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=4)
def counter(path: str) -> JsonCounter | ModelCounter:
    return ModelCounter(path) if path.endswith(".model") else JsonCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_column: str = "doc_id") -> DataFrame:
    """One row a document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; rows that repeat give a row
    each; a null id stays null; other columns are left out, whatever their names;
    an empty table gives none. No truncation, no special tokens added. Texts of
    any length are counted whole, piece by piece between safe boundaries; batches
    hold at most `BATCH_BYTES` of text, or one text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer_path)
        for batch in slices(batches, "text", BATCH_BYTES):
            text = batch.column(1)
            n = pa.array(counts.count([t or "" for t in text.to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()), n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
