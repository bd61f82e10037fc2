"""The streamed graph has every week of a finite table, also those open at its end."""

from helpers import rows
from threadloom.plans.catalogue import ORACLE_SQL, QUERIES

KEPT = "where author <> '[deleted]'"
CLOSED = f"{KEPT} and (week + 1) * 604800 <= (select max(epoch(ts)) from events) - 86400"


def test_streamed_edges_have_the_open_weeks(spark, small, duck):
    sql = ORACLE_SQL["g23_streamed_edges"]
    assert KEPT in sql
    got, closed, whole = QUERIES["g23_streamed_edges"](spark, small).toPandas(), duck.sql(sql.replace(KEPT, CLOSED)).df(), duck.sql(sql).df()
    assert rows(got) == rows(whole)
    assert len(got) > len(closed)
