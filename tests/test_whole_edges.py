"""The edge table under the graph queries is whole: no author, pair or weight is left out before the operators see it."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from threadloom.plans import sql_views
from threadloom.plans.catalogue import ORACLE_SQL, QUERIES, graph_edges

WHOLE = "select 'cocomment' as method, snapshot, src, dst, weight::double as weight from g22 union all select 'sentiment', snapshot, src, dst, weight::double from g23"
BODY = "select method, snapshot, src, dst, weight from edges"


@pytest.fixture
def whole(monkeypatch):
    """SQL over the whole edge table: the registered view ``edges`` is replaced for the test."""
    monkeypatch.setitem(sql_views.VIEWS, "edges", WHOLE)
    return sql_views.with_views


def test_edges_are_those_of_g22_and_g23(spark, small, duck, whole):
    assert rows(graph_edges(spark, small).toPandas()) == rows(duck.sql(whole(BODY)).df())


@pytest.mark.parametrize("name", ["g1_density", "a11_degrees", "l9_auc"])
def test_queries_read_the_whole_edges(spark, small, duck, whole, name):
    body = ORACLE_SQL[name].rsplit(")\n", 1)[1]
    assert rows(QUERIES[name](spark, small).toPandas()) == rows(duck.sql(whole(body)).df())


def test_edges_read_each_event_once(spark, small, tmp_path):
    """Besides the list of bots, which reads the events for itself."""
    rows_in = spark.read.parquet(f"{small}/events.parquet").select("*", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("_")).drop("_")
    rows_in.write.parquet(str(tmp_path / "events.parquet"))
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def read():
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.inputRecords() for s in map(stages.apply, range(stages.size()))}

    before = read()
    graph_edges(spark, str(tmp_path))
    assert sum(n for k, n in read().items() if k not in before) < 2.5 * 50_000
