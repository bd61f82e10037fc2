"""Queries of the llm operators against DuckDB."""

import pytest

from helpers import rows
from threadloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, duck, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
