"""Versions of documents made by patches in order: null removes, maps merge in depth, numbers that aren't finite become null."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(value: Any) -> Any:
    """Non-finite numbers as None, at any depth."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [finite(v) for v in value]
    return value


def merged(document: Any, patch: Any) -> Any:
    """The document after the patch. A field set to null goes; one set to a number that isn't finite stays as null; any patch but a map replaces all."""
    if not isinstance(patch, dict):
        return finite(patch)
    out = dict(document) if isinstance(document, dict) else {}
    for name, value in patch.items():
        if value is None:
            out.pop(name, None)
        else:
            out[name] = merged(out.get(name), value) if isinstance(value, dict) else finite(value)
    return out


def canonical(document: Any) -> str:
    return json.dumps(document, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def versions(patches: DataFrame, key: str, order: list[str], patch: str) -> DataFrame:
    """(key, order, version, document): a row for each patch (JSON text) that changes its object's document; document is a VARIANT.

    Patches of an object are applied by `order`; one that leaves the document as it is gives no version, and neither do null or unreadable ones.
    Rows come sorted and one document is held at a time, so memory doesn't follow the number of an object's patches.
    """
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = dict(patches.dtypes)
    names = [key, *order, "version", "text"]
    schema = pa.schema([*((n, kinds[types[n]]) for n in [key, *order]), ("version", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Any = run
        document, text, number = None, "", 0
        for batch in batches:
            out = []
            for own, *when, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != current:
                    current, document, text, number = own, {}, "", 0
                try:
                    document = merged(document, json.loads(raw)) if raw is not None else document
                except ValueError:
                    continue
                after = canonical(document)
                if raw is not None and after != text:
                    text, number = after, number + 1
                    out.append((own, *when, number, after))
            if out:
                yield pa.RecordBatch.from_pydict({n: [o[i] for o in out] for i, n in enumerate(names)}, schema=schema)

    rows = patches.select(key, *order, patch).repartition(key).sortWithinPartitions(key, *order)
    ddl = ", ".join(f"{n} {types[n]}" for n in [key, *order]) + ", version bigint, text string"
    return rows.mapInArrow(run, ddl).select(key, *order, "version", F.parse_json("text").alias("document"))
