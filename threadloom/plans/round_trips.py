"""Queries over sources and sinks: a domain table goes out through a writer and comes back through a reader.

Files lie in the shared folder; the SQL runs on the tables that they were made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import scratch
from ..operators import edges as E
from ..operators import interactions
from ..sources import readers, sinks, views
from .registry import query

_MONTH_SQL = "concat('2016-', lpad((snapshot + 8)::varchar, 2, '0'))"
_COMMENT = ["id", "author", "subreddit", "score", "month"]
_COMMENT_SQL = f"select id::varchar as id, author, community as subreddit, score, {_MONTH_SQL} as month from comments"


def _month() -> Column:
    """Weeks as months of file names."""
    return F.concat(F.lit("2016-"), F.lpad((F.col("snapshot") + 8).cast("string"), 2, "0"))


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.comments(spark, sf_dir)
    return c.select(F.col("id").cast("string").alias("id"), "author", F.col("community").alias("subreddit"), "score", _month().alias("month"))


def _written(spark: SparkSession, sf_dir: str, codec: str | None) -> str:
    path = f"{scratch(spark, 'comments')}/comments"
    sinks.write_json_lines(_comments(spark, sf_dir), path, ["month"], codec, spread=True)
    return path


@query(_COMMENT_SQL)
def s1_compressed_comments(spark, sf_dir):
    return readers.read_comments(spark, _written(spark, sf_dir, "bzip2")).select(*_COMMENT)


@query(_COMMENT_SQL)
def s2_plain_comments(spark, sf_dir):
    return readers.read_comments(spark, _written(spark, sf_dir, None)).select(*_COMMENT)


@query(f"select * from ({_COMMENT_SQL}) where month between '2016-09' and '2016-11'")
def s3_month_range(spark, sf_dir):
    return readers.read_comments(spark, _written(spark, sf_dir, "bzip2"), "2016-09", "2016-11").select(*_COMMENT)


@query(f"select * from ({_COMMENT_SQL}) where month = '2016-10'")
def s4_file_pattern(spark, sf_dir):
    """Plain and compressed files in one folder; the pattern picks the compressed ones."""
    rows, path = _comments(spark, sf_dir), scratch(spark, "patterns")
    sinks.write_json_lines(rows.filter("month <> '2016-10'"), path, ["month"])
    sinks.write_json_lines(rows.filter("month = '2016-10'"), path, ["month"], "bzip2", append=True, spread=True)
    return readers.read_comments(spark, path, pattern="*.json.bz2").select(*_COMMENT)


def _in_order(rows: DataFrame, path: str) -> str:
    """One CSV file whose lines are in the order of its columns."""
    rows.coalesce(1).sortWithinPartitions(*rows.columns).write.option("header", True).csv(path)
    return path


@query("""select node_1 as src, node_2 as dst, arg_max(weighted, yr)::double as weight from networks where weighted > 1 group by node_1, node_2""")
def s5_weighted_edges(spark, sf_dir):
    """The years of the networks one after the other in a file; a pair's last positive weight stays. Weights of 1 are written as 0."""
    n = views.networks(spark, sf_dir).select("yr", F.col("node_2").alias("node_1"), F.col("node_1").alias("node_2"), F.when(F.col("weighted") > 1, F.col("weighted")).otherwise(0).alias("weighted"), "unweighted")
    return readers.read_edges(spark, _in_order(n, scratch(spark, "edges")))


@query("select node_1 as src, node_2 as dst, arg_max(weighted, yr)::double as weight from networks where unweighted = 1 group by node_1, node_2")
def s6_flagged_edges(spark, sf_dir):
    n = views.networks(spark, sf_dir).select("yr", "node_1", "node_2", "weighted", "unweighted")
    return readers.read_edges(spark, _in_order(n, scratch(spark, "edges")), use_weights=False)


def _yearly(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "networks")
    n = views.networks(spark, sf_dir)
    n.withColumn("network", n["yr"]).drop("yr").write.partitionBy("network").option("header", True).csv(path)
    return path


@query("select yr, node_1, node_2, weighted::double as weighted, 1 as unweighted from networks where unweighted = 1 and yr = 1996")
def s8_yearly_network(spark, sf_dir):
    return readers.read_networks(spark, f"{_yearly(spark, sf_dir)}/network=1996").filter("unweighted = 1")


@query("select yr, node_1, node_2, weighted::double as weighted, unweighted from networks")
def s9_all_networks(spark, sf_dir):
    return readers.read_networks(spark, _yearly(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str, twice: bool = False) -> str:
    """Brand metadata as JSON lines; with ``twice``, records of banned brands come again, with another party, after the first."""
    path = scratch(spark, "metadata")
    m = views.brand_meta(spark, sf_dir).select(F.lit(0).alias("turn"), F.col("node").alias("subreddit"), "party", "banned", "gun")
    if twice:
        m = m.unionByName(m.filter("banned = 1").withColumns({"turn": F.lit(1), "party": F.lit("rep")}))
    one_file = m.coalesce(1).sortWithinPartitions("turn", "subreddit").drop("turn")
    sinks.write_json_lines(one_file, path)
    return path


@query("select node, case when banned = 1 then 'rep' else party end as label from brand_meta where party <> '' or banned = 1")
def s10_labels(spark, sf_dir):
    return readers.read_labels(spark, _records(spark, sf_dir, twice=True), "party")


@query("select node as subreddit, case when party = 'rep' then '' else party end as party, case when party = 'rep' then 0 else banned end as banned, gun from brand_meta")
def s11_metadata(spark, sf_dir):
    """Null parties and flags that are no numbers come back as '' and 0; records without a name and broken lines do not."""
    path = scratch(spark, "metadata")
    rep = F.col("party") == "rep"
    m = views.brand_meta(spark, sf_dir).select(F.col("node").alias("subreddit"), F.when(~rep, F.col("party")).alias("party"), F.when(rep, "none").otherwise(F.col("banned").cast("string")).alias("banned"), F.col("gun").cast("double").alias("gun"))
    sinks.write_json_lines(m, path)
    sinks.write_json_lines(m.withColumn("subreddit", F.lit(None).cast("string")).limit(3), path, append=True)
    m.limit(2).select(F.lit('{"subreddit": "broken').alias("value")).write.mode("append").text(path)
    return readers.read_metadata(spark, path)


@query("select author from bots")
def s12_bots(spark, sf_dir):
    path = scratch(spark, "bots")
    users = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("author"), (F.col("user_id") % 50 == 7).cast("int").alias("bot")).distinct()
    sinks.write_json_lines(users, path)
    return readers.read_bots(spark, path)


@query("select community as subreddit from meta where party <> ''")
def s13_list(spark, sf_dir):
    path = scratch(spark, "list")
    names = views.meta(spark, sf_dir).select(F.explode(F.array(F.when(F.col("party") != "", F.concat(F.lit("  "), "community", F.lit(" "))).otherwise(""), F.lit("   "))).alias("value"))
    names.write.text(path)
    return readers.read_list(spark, path)


def _sentiment_csv(spark: SparkSession, sf_dir: str) -> str:
    c = interactions.clean_comments(views.comments(spark, sf_dir), views.bots(spark, sf_dir))
    path = scratch(spark, "graphs")
    sinks.write_edges(interactions.labelled(interactions.sentiment_edges(c), "sentiment").withColumn("snapshot", _month()).drop("method"), path, "csv")
    return path


@query(f"select 'sentiment' as method, {_MONTH_SQL} as snapshot, src, dst, weight::double as weight from g23")
def s14_monthly_graphs(spark, sf_dir):
    return readers.read_snapshots(spark, _sentiment_csv(spark, sf_dir), "sentiment")


@query("select node as subreddit, party, banned, gun from brand_meta")
def s15_records(spark, sf_dir):
    return readers.read_json_lines(spark, _records(spark, sf_dir), "subreddit string, party string, banned int, gun int")


@query("select c.id::varchar as id, c.author, null::varchar as body from comments c where community in (select community from meta where party <> '') and author not in (select author from bots)")
def s16_loaded_comments(spark, sf_dir):
    allowed = views.meta(spark, sf_dir).filter("party <> ''").select(F.col("community").alias("subreddit"))
    return readers.load_comments(_comments(spark, sf_dir), ["id", "author", "body"], views.bots(spark, sf_dir), allowed)


@query("select community as subreddit, count(*)::bigint as n, sum(score)::bigint as total, max(score)::bigint as most from comments group by community")
def s17_folded_comments(spark, sf_dir):
    """A user's aggregate by partition, with its own merge."""
    parts = {"n": lambda: F.count("*"), "total": lambda: F.sum("score"), "most": lambda: F.max("score")}
    return readers.fold(_comments(spark, sf_dir), ["subreddit"], parts, {"n": F.sum, "total": F.sum, "most": F.max})


_STATS_SQL = "select yr, count(*) as n_edges, sum(weighted)::bigint as total_weight from networks group by yr"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.networks(spark, sf_dir).groupBy("yr").agg(F.count("*").alias("n_edges"), F.sum("weighted").alias("total_weight"))


@query(_STATS_SQL)
def s18_earlier_stage(spark, sf_dir):
    """A stage's CSV read back, together with one that was never written."""
    path, schema = scratch(spark, "stage"), "yr long, n_edges long, total_weight long"
    sinks.write_metrics(_stats(spark, sf_dir), path, ["yr"])
    return readers.read_or_empty(spark, path, schema).unionByName(readers.read_or_empty(spark, f"{path}-absent", schema))


@query("select src as subreddit_a, dst as subreddit_b, weight::double as weight from g22 where weight > 1")
def k1_edge_csv(spark, sf_dir):
    """Each pair once, a before b, positive weights only; weights of 1 are taken as 0 before writing."""
    c = interactions.clean_comments(views.comments(spark, sf_dir), views.bots(spark, sf_dir))
    path, e = scratch(spark, "csv"), interactions.cocomment_edges(c)
    sinks.write_edges(e.withColumn("weight", F.when(F.col("weight") > 1, F.col("weight")).otherwise(0)).drop("snapshot"), path, "csv")
    return spark.read.option("header", True).schema("subreddit_a string, subreddit_b string, weight double").csv(path)


@query("select method, snapshot, src, dst, weight from edges")
def k2_edge_table(spark, sf_dir):
    """Parquet by method and snapshot."""
    c = interactions.clean_comments(views.comments(spark, sf_dir), views.bots(spark, sf_dir))
    path = scratch(spark, "edges")
    both = interactions.edge_table(c)
    sinks.write_edges(both, path)
    return spark.read.schema("src string, dst string, weight double, method string, snapshot long").parquet(path).select("method", "snapshot", "src", "dst", "weight")


@query("select * from summary")
def k3_author_summary(spark, sf_dir):
    path = scratch(spark, "summary")
    s = interactions.sentiment_summary(interactions.clean_comments(views.comments(spark, sf_dir), views.bots(spark, sf_dir)))
    sinks.write_rows(s, path)
    return spark.read.option("header", True).schema(s.schema).csv(path)


@query("select id, link_id, author, body_cleaned from threads")
def k4_json_lines(spark, sf_dir):
    """Chunks appended to a table that replaced an older one."""
    t, path = views.threads(spark, sf_dir).select("id", "link_id", "author", "body_cleaned"), scratch(spark, "jsonl")
    sinks.write_json_lines(t.limit(5), path)
    user = F.col("author").eqNullSafe(F.lit("user"))
    sinks.write_json_lines(t.filter(user), path)
    sinks.write_json_lines(t.filter(~user), path, append=True)
    return readers.read_json_lines(spark, path, "id string, link_id string, author string, body_cleaned string")


@query("select id::varchar as id, author, community as subreddit, score from clean")
def k5_filtered_comments(spark, sf_dir):
    path = scratch(spark, "filtered")
    c = interactions.clean_comments(views.comments(spark, sf_dir), views.bots(spark, sf_dir))
    sinks.write_json_lines(c.select(F.col("id").cast("string").alias("id"), "author", F.col("community").alias("subreddit"), "score"), path, codec="bzip2", spread=True)
    return readers.read_comments(spark, path).select("id", "author", "subreddit", "score")


@query(_STATS_SQL)
def k6_metrics(spark, sf_dir):
    path = scratch(spark, "metrics")
    sinks.write_metrics(_stats(spark, sf_dir), path, ["yr"])
    return spark.read.option("header", True).schema("yr long, n_edges long, total_weight long").csv(path)


@query(f"select yr, unnest(['n_edges', 'total_weight']) as metric, unnest([n_edges, total_weight])::double as value from ({_STATS_SQL})")
def k7_metric_lines(spark, sf_dir):
    """The table behind line plots of metrics over the years."""
    return sinks.tidy(_stats(spark, sf_dir), ["yr"], ["n_edges", "total_weight"])


@query("select count(*) as n_lines from comments")
def a23_line_count(spark, sf_dir):
    return readers.count_lines(spark, _written(spark, sf_dir, "bzip2"))


@query("select method, snapshot, src, dst, weight from edges union all select 'flag', yr, node_1, node_2, 1 from backbone")
def g12_edge_weights(spark, sf_dir):
    """Weights of the interaction graphs, and 1 for edges that have none."""
    c = interactions.clean_comments(views.comments(spark, sf_dir), views.bots(spark, sf_dir))
    both = interactions.edge_table(c)
    b = E.backbone(views.networks(spark, sf_dir)).select(F.lit("flag").alias("method"), F.col("yr").alias("snapshot"), F.col("node_1").alias("src"), F.col("node_2").alias("dst"))
    return E.weights(both).unionByName(E.weights(b))
