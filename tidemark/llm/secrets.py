"""Secret scans with DataFrame functions only.

Pattern kinds (assign, access, hex) are found by splitting the text at the
pattern's matches: what lies between the matches and the matches themselves, in
turn, give every position in code points.

Positions are running sums of lengths, built in blocks, so their cost follows
the number of matches.

Candidate strings of the entropy kind are long runs of token characters that
mix letters and digits. Over each a window slides; the counts of its characters
are kept up by adding the character that enters and taking the one that leaves,
and with them the sum of n log2 n, from which the window's Shannon entropy
follows. Each character class (hexadecimal, base 64) has an alphabet and a
threshold of its own. Strings that an allow-list pattern matches are suppressed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<s:int,k:int,e:int>"


@dataclass(frozen=True)
class CharClass:
    """One class of candidate strings: its alphabet and the entropy in bits that a window must reach."""

    name: str
    alphabet: str
    threshold: float


HEX_CLASS = CharClass("hex", "0123456789abcdef", 3.0)
BASE64_CLASS = CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.7)
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: Strings that look random but are none: placeholders, runs of one character, UUIDs, dates, and words and numbers joined by
#: dashes or slashes (no letter beside a digit). Each is a plain scan: java.util.regex recurses in repeated groups.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0000000|1234567|abcdefg",
    r"^(.)\1+$",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^\d{4}-\d{2}-\d{2}",
    r"^(?!.*(?:[A-Za-z][0-9]|[0-9][A-Za-z]))[A-Za-z0-9]",
)
#: Values that one array grows by at a time; units of one in entropy sums.
BLOCK, SCALE = 256, 1 << 40


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a name for the value: inside lambdas an expression is worked out anew at each use, a name is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Zero, then the running results of op over an array of integers, one more than values.

    An array grows by copying, so runs are built in blocks and joined: BLOCK + n / BLOCK copies a value, not n.
    """
    zero = F.array(F.lit(0))
    grow = lambda xs: F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def joined(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: grow(F.slice(xs, b * BLOCK + 1, BLOCK)))

        def shifted(each: Column) -> Column:
            before = grow(F.transform(each, lambda run: F.element_at(run, -1)))
            return F.concat(zero, F.flatten(F.zip_with(each, F.slice(before, F.lit(1), F.size(each)), lambda run, by: F.transform(F.slice(run, F.lit(2), F.size(run) - 1), lambda x: op(by, x)))))

        return _let(blocks, shifted)

    return _let(values, lambda xs: F.when(F.size(xs) > 0, joined(xs)).otherwise(zero))


def _matches(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the pattern's matches, leftmost and not overlapping, of which `keep` holds."""

    def placed(found: Column, gaps: Column) -> Column:
        lengths = F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, m: F.array(gap, F.length(m))))

        def spans(at: Column) -> Column:
            each = F.transform(found, lambda m, i: F.when(keep(m), F.struct(F.element_at(at, 2 * i + 2).alias("s"), F.lit(kind).alias("k"), F.element_at(at, 2 * i + 3).alias("e"))))
            return F.filter(each, lambda x: x.isNotNull())

        return _let(_running(lengths, lambda x, y: x + y), spans)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    spans = _let(found, lambda f: _let(gaps, lambda g: placed(f, g)))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _weight(count: int) -> int:
    """count log2 count in units of 2**-40, so that sums of them are exact whatever their order and number."""
    return round(count * math.log2(count) * SCALE) if count else 0


def window_entropy(text: Column, alphabet: str, width: int) -> Column:
    """The highest Shannon entropy, in bits, of any `width` characters in a row (of the whole, if shorter), by incremental counts.

    Characters outside the alphabet count as one further character. The counts
    are packed into a few integers, so a step costs the same wherever it stands
    and however long the text is.
    """
    bits = width.bit_length()
    fields = 63 // bits
    size = -(-(len(alphabet) + 1) // fields)
    code = {ord(c): k + 1 for k, c in enumerate(alphabet)}
    codes = F.array(*[F.lit(code.get(c, 0)) for c in range(128)])
    gain = F.array(*[F.lit(_weight(c + 1) - _weight(c)) for c in range(width + 1)])
    mask = (1 << bits) - 1
    none = F.lit(-1)
    names = [f"n{k}" for k in range(size)]
    zero = F.lit(0).cast("long")

    def count(acc: Column, c: Column) -> Column:
        """The count of code c."""
        word = acc[names[-1]]
        for k in range(size - 2, -1, -1):
            word = F.when(c < (k + 1) * fields, acc[names[k]]).otherwise(word)
        return F.call_function("shiftright", word, F.pmod(c, F.lit(fields)) * bits).bitwiseAND(F.lit(mask).cast("long")).cast("int")

    def moved(acc: Column, c: Column, by: int) -> list[Column]:
        """The packed counts with that of code c one up or down."""
        unit = F.call_function("shiftleft", F.lit(by).cast("long"), F.pmod(c, F.lit(fields)) * bits)
        return [F.when((c >= k * fields) & (c < (k + 1) * fields), acc[n] + unit).otherwise(acc[n]).alias(n) for k, n in enumerate(names)]

    def add(acc: Column, c: Column) -> Column:
        return F.struct(*moved(acc, c, 1), (acc["s"] + F.element_at(gain, count(acc, c) + 1)).alias("s"), acc["i"].alias("i"), acc["least"].alias("least"))

    def drop(acc: Column, c: Column) -> Column:
        return F.struct(*moved(acc, c, -1), (acc["s"] - F.element_at(gain, count(acc, c))).alias("s"), acc["i"].alias("i"), acc["least"].alias("least"))

    def slide(acc: Column, x: Column) -> Column:
        kept = _let(acc, lambda a: F.when(x["out"] >= 0, drop(a, x["out"])).otherwise(a))
        full = lambda a: F.struct(
            *[a[n].alias(n) for n in names], a["s"].alias("s"), (a["i"] + 1).alias("i"), F.when(a["i"] + 1 >= F.lit(width), F.least(a["least"], a["s"])).otherwise(a["least"]).alias("least")
        )
        return _let(_let(kept, lambda a: add(a, x["new"])), full)

    def over(new: Column) -> Column:
        steps = F.zip_with(new, F.slice(F.concat(F.array_repeat(none, width), new), F.lit(1), F.size(new)), lambda a, b: F.struct(a.alias("new"), b.alias("out")))
        start = F.struct(*[zero.alias(n) for n in names], zero.alias("s"), F.lit(0).alias("i"), F.lit(None).cast("long").alias("least"))
        # The sum of n log2 n is least where entropy is highest.
        return F.aggregate(steps, start, slide, lambda acc: F.log2(F.least(acc["i"], F.lit(width)).cast("double")) - F.coalesce(acc["least"], acc["s"]) / F.lit(SCALE) / F.least(acc["i"], F.lit(width)))

    coded = F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) < 128, F.element_at(codes, F.least(F.ascii(c), F.lit(127)) + 1)).otherwise(F.lit(0)))
    return F.when(F.length(text) > 0, _let(coded, over)).otherwise(F.lit(0.0))


def secret_spans(text: Column, width: int = 20, classes: tuple[CharClass, ...] = (HEX_CLASS, BASE64_CLASS), allowed: tuple[str, ...] = ALLOWED) -> Column:
    """An array of (s, k, e): start and end in code points and the kind's number, by start, then kind.

    Null and empty texts have none. Kinds 0 to 2 are patterns; kind 3 are strings of high entropy.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))

    def suspicious(m: Column) -> Column:
        hexed = m.rlike("^[0-9a-f]+$")
        mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        listed = F.lit(False)
        for pattern in allowed:
            listed = listed | m.rlike(pattern)
        high = F.lit(False)
        for c in classes:
            own = hexed if c.name == "hex" else ~hexed
            high = F.when(own, window_entropy(m, c.alphabet, width) >= c.threshold).otherwise(high)
        return F.when(mixed & ~listed, high).otherwise(F.lit(False))

    spans = F.concat(
        _matches(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        _matches(text, ACCESS, 1, lambda m: F.length(m) >= 20),
        _matches(text, HEX, 2, lambda m: F.lit(True)),
        _matches(text, CANDIDATE, 3, suspicious),
    )
    return F.array_sort(spans)


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no span (spans is an empty string); repeated rows
    give a row each; a null doc_id stays null; other columns are left out. Spans
    of one start are ordered by kind. A text of any length is scanned whole, at a
    cost that follows its length (a megabyte takes seconds in one task).
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), secret_spans(F.col("text")).alias("secret_spans"))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("secret_spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("secret_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by the mark; overlapping spans count as one.

    Texts without a span, null texts among them, stay as they are; all rows and
    columns stay, whatever their names; an empty table gives none.
    """
    name = free(docs.columns, "spans")
    found = docs.withColumn(name, secret_spans(F.col("text")))

    def cut(chars: Column, spans: Column, reach: Column) -> Column:
        plain = lambda start, end: F.array_join(F.slice(chars, start + 1, F.greatest(end - start, F.lit(0))), "")
        pieces = F.transform(spans, lambda x, i: F.when(x["s"] >= F.element_at(reach, i + 1), F.concat(plain(F.element_at(reach, i + 1), x["s"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), plain(F.element_at(reach, -1), F.size(chars)))

    # How far the spans before reach.
    reach = _running(F.transform(name, lambda x: x["e"]), lambda x, y: F.greatest(x, y))
    text = _let(F.split("text", ""), lambda chars: _let(F.col(name), lambda spans: _let(reach, lambda r: cut(chars, spans, r))))
    return found.withColumn("text", F.when(F.size(name) > 0, text).otherwise(F.col("text"))).select(*docs.columns)
