"""The numbered queries against their SQL, on the smallest tables; and their columns."""

from __future__ import annotations

import pytest

from tests.compare import connect, duck_rows, spark_rows
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    assert spark_rows(QUERIES[name](spark, data)) == duck_rows(connect(data), SQL[name])


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
