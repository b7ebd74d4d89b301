"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tidemark import registry

from .compare import connect, duck_rows, spark_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    assert spark_rows(QUERIES[name](spark, data)) == duck_rows(duck, SQL[name])


@pytest.mark.parametrize("name", ["nfkc", "events_extract", "html_text", "block_bootstrap", "isotonic", "paired_baselines"])
def test_gives_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns
    assert df.count() > 0
