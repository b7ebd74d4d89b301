from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

WORDS = ["alpha", "beta", "gamma", "delta", "Eps", "zeta", "été", "漢字", "theta", "iota", "kappa", "42"]
#: Columns whose names the operators use inside.
CLASH = ["rid", "spans", "features", "n", "component_id", "id", "secret_spans"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASH]])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(500))]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base, shared = prose(rng, 90), prose(rng, 45)
    out: list[tuple[int | None, str | None]] = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   \n"), (6, "one two"), (7, "One TWO"), (None, base), (None, None)]
    for i in range(10, 30):
        ws = base.split()
        for _ in range(rng.randrange(1, 9)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(99)}"
        out.append((i, " ".join(ws)))
    for i in range(30, 40):
        out.append((i, f"{prose(rng, 30)} {shared}\t{prose(rng, 20)}"))
    out.append((50, " ".join([shared] * 3)))
    out.append((51, "spam " * 4000))
    out.append((52, prose(rng, 6000)))
    out += [(i, prose(rng, rng.randrange(1, 60))) for i in range(60, 80)]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(CLASH)) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
