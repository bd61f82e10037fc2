"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from helpers import rows
from threadloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, duck, name):
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())
