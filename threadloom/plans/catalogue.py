"""Every query by name, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import category_colour, cosine, jaccard
from ..functions.lineage import cut, kept, scratch
from ..operators import edges as E
from ..operators import embeddings, graphs, interactions, links, louvain, paths, quality, ranking, sentiment, spectral, temporal, text, topics
from ..sources import readers, views
from . import round_trips, words_and_layout  # noqa: F401  their queries are registered too
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.clean_comments(views.comments(spark, sf_dir), views.bots(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge table of both methods that the graph queries share, checkpointed: each reads it several times."""
    return cut(interactions.edge_table(clean(spark, sf_dir)))


def backbone_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.backbone(views.networks(spark, sf_dir))
    return b.select("yr", F.col("node_1").alias("src"), F.col("node_2").alias("dst"), F.col("weighted").cast("double").alias("weight"))


# Interactions


@query("select id, author, community, score, snapshot from clean")
def p1_clean_comments(spark, sf_dir):
    return clean(spark, sf_dir)


@query("select snapshot, author, community, n from activity where n >= 2")
def a1_author_community_counts(spark, sf_dir):
    return interactions.activity(clean(spark, sf_dir), 2)


@query("select * from summary")
def a2_sentiment_summary(spark, sf_dir):
    return interactions.sentiment_summary(clean(spark, sf_dir))


@query("select snapshot, src, dst, weight from g22")
def g22_cocomment_edges(spark, sf_dir):
    return interactions.cocomment_edges(clean(spark, sf_dir))


@query("select snapshot, src, dst, weight from g23")
def g23_sentiment_edges(spark, sf_dir):
    return interactions.sentiment_edges(clean(spark, sf_dir))


@query("select method, snapshot, src, dst, weight from edges where weight >= 5")
def p6_weight_threshold(spark, sf_dir):
    return E.heavier(graph_edges(spark, sf_dir), 5)


# Yearly networks


@query("select yr, node_1, node_2, weighted from backbone")
def s6_backbone_edges(spark, sf_dir):
    return E.backbone(views.networks(spark, sf_dir))


@query("""select yr, count(distinct node) as n_nodes, any_value(n_edges) as n_edges, any_value(total) as total_weight from ends
join (select yr, count(distinct (least(node_1, node_2), greatest(node_1, node_2))) as n_edges, sum(weighted)::bigint as total from networks group by yr) using (yr) group by yr""")
def a9_yearly_network_stats(spark, sf_dir):
    return E.yearly_stats(views.networks(spark, sf_dir))


@query("select (select count(distinct node) from ends) as n_nodes, (select count(distinct (least(node_1, node_2), greatest(node_1, node_2))) from networks) as n_edges")
def a10_total_nodes_edges(spark, sf_dir):
    return E.total_counts(views.networks(spark, sf_dir))


_PERSISTENT = """(with seen as (select distinct yr, node from (select yr, node_1 as node from backbone union all select yr, node_2 from backbone)),
numbered as (select yr, row_number() over (order by yr) as k from (select distinct yr from backbone)),
runs as (select s.node, s.yr, k - row_number() over (partition by s.node order by k) as run from seen s join numbered using (yr))
select node, min(yr) as first_year, max(yr) as last_year, count(*) as n_years from runs group by node, run having count(*) >= 5)"""


@query(f"select * from {_PERSISTENT} as p, (select 1 from backbone limit 1) as one(x)".replace("select *", "select node, first_year, last_year, n_years"))
def w3_persistent_nodes(spark, sf_dir):
    return E.persistent_nodes(E.backbone(views.networks(spark, sf_dir)))


@query(f"""select yr, count(*) as n_rows, count(*) filter (node_1 in (select node from {_PERSISTENT}) and node_2 in (select node from {_PERSISTENT})) as n_kept,
round(100.0 * count(*) filter (node_1 in (select node from {_PERSISTENT}) and node_2 in (select node from {_PERSISTENT})) / count(*), 6)::double as pct from backbone group by yr""")
def a13_edge_retention(spark, sf_dir):
    b = E.backbone(views.networks(spark, sf_dir))
    return E.retention(b, E.persistent_nodes(b))


@query("select node, strength, mean_weight from strength")
def a11_node_strength(spark, sf_dir):
    return E.node_strength(views.networks(spark, sf_dir))


@query("select place, node, strength from strongest")
def o1_top10_strength(spark, sf_dir):
    return E.strongest(views.networks(spark, sf_dir))


@query("""select place, s.node, strength, coalesce(party, '') as party, coalesce(gun, 0) as gun, coalesce(banned, 0) as banned,
case party when 'dem' then 'blue' when 'rep' then 'red' else 'gray' end as party_colour, case when gun <> 0 then 'orange' else 'gray' end as gun_colour,
case when banned <> 0 then 'black' else 'gray' end as banned_colour from strongest s left join brand_meta m on s.node = m.node""")
def j7_top10_with_metadata(spark, sf_dir):
    top = E.strongest(views.networks(spark, sf_dir)).join(views.brand_meta(spark, sf_dir), "node", "left")
    top = top.select("place", "node", "strength", F.coalesce("party", F.lit("")).alias("party"), F.coalesce("gun", F.lit(0)).alias("gun"), F.coalesce("banned", F.lit(0)).alias("banned"))
    colours = {f"{k}_colour": category_colour(k, F.col("party"), F.col("gun"), F.col("banned")) for k in ("party", "gun", "banned")}
    return top.withColumns(colours)


@query("select yr, " + ", ".join(f"sum(weighted) filter (place = {p})::bigint as place_{p}" for p in range(1, 11)) + " from ends join strongest using (node) group by yr")
def a12_topk_yearly_pivot(spark, sf_dir):
    return E.strength_by_year(views.networks(spark, sf_dir))


@query("select b.yr, b.node_1, b.node_2, b.weighted from backbone b where node_1 in (select node from strongest) or node_2 in (select node from strongest)")
def p12_edges_of_top10(spark, sf_dir):
    b = E.backbone(views.networks(spark, sf_dir)).withColumnsRenamed({"node_1": "src", "node_2": "dst"})
    kept = E.within(b, E.strongest(views.networks(spark, sf_dir)).select("node"), both=False)
    return kept.withColumnsRenamed({"src": "node_1", "dst": "node_2"})


# Threads


@query("select link_id, count(distinct parent_id) as n from threads group by link_id having count(distinct parent_id) > 1")
def a6_multi_parent_links(spark, sf_dir):
    return text.several(views.threads(spark, sf_dir), "parent_id", "link_id")


@query("select parent_id, count(distinct link_id) as n from threads group by parent_id having count(distinct link_id) > 1")
def a6_multi_link_parents(spark, sf_dir):
    return text.several(views.threads(spark, sf_dir), "link_id", "parent_id")


@query("""select count(distinct link_id) as links, count(distinct parent_id) as parents, count(*) as n_comments,
round(count(*) / nullif(count(distinct link_id), 0), 6)::double as per_link, round(count(*) / nullif(count(distinct parent_id), 0), 6)::double as per_parent from threads""")
def a7_thread_ratios(spark, sf_dir):
    return text.thread_ratios(views.threads(spark, sf_dir))


@query("select count(*) filter (coalesce(link_id = parent_id, false)) as top_level, count(*) filter (not coalesce(link_id = parent_id, false)) as replies, count(*) as n_comments from threads")
def a8_reply_types(spark, sf_dir):
    return text.reply_types(views.threads(spark, sf_dir))


@query("select distinct link_id, parent_id from threads order by link_id, parent_id limit 10")
def o2_distinct_pairs_sample(spark, sf_dir):
    return text.distinct_pairs(views.threads(spark, sf_dir))


_BLANK = r"regexp_full_match(body_cleaned, '[\t-\r\x1c-\x20\x85\p{Z}]*')"


@query(f"select link_id, string_agg(body_cleaned, ' ' order by pos, id) as text, count(*) as n_comments from threads where body_cleaned is not null and not {_BLANK} group by link_id")
def a5_thread_documents(spark, sf_dir):
    return text.thread_documents(views.threads(spark, sf_dir))


#: A short list for the token queries; ``topics.stopwords`` has Spark's own.
STOP = ("the", "and", "der", "die", "und", "les", "des", "que", "los", "las", "for", "with")
_TOKENS = rf"""list_filter(string_split_regex(lower(coalesce(text, '')), '{text.SPACE}'), lambda t: length(t) >= 3 and not list_contains([{", ".join(f"'{w}'" for w in STOP)}], t)
  and not starts_with(t, chr(39)) and not starts_with(t, '...') and not regexp_full_match(t, '\p{{Nd}}+') and not regexp_full_match(t, '[!-/:-@\[-`{{-~]+'))"""


def doc_tokens(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text"), STOP).alias("tokens"))


_DOCS = f"(select doc_id, {_TOKENS} as tokens from documents)"
_LONG = f"(select * from {_DOCS} where len(tokens) >= 5)"
_VOCABULARY = f"""(select term, df from (select term, count(*) as df from (select unnest(list_distinct(tokens)) as term from {_LONG}) group by term)
  where df >= 3 and df <= 0.6 * (select count(*) from {_LONG}) order by df desc, term limit 3000)"""


@query(f"select doc_id, len(tokens)::bigint as n_tokens, md5(array_to_string(tokens, ' ')) as tokens_md5 from {_DOCS}")
def f5_tokens(spark, sf_dir):
    return doc_tokens(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


_PLAIN = f"""list_filter(regexp_extract_all(regexp_replace(translate(lower(coalesce(text, '')), '{"".join(text._ACCENTED)}', '{"".join(text._ACCENTED.values())}'), '{text._MARK}', '', 'g'), '{text._LETTERS}'),
  lambda t: length(t) between 3 and 15 and not starts_with(t, '_'))"""


@query(f"select doc_id, len(tokens)::bigint as n_tokens, md5(array_to_string(tokens, ' ')) as tokens_md5 from (select doc_id, {_PLAIN} as tokens from documents)")
def f6_plain_tokens(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", text.plain_tokens(F.col("text")).alias("tokens"))
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query(f"select term, df from {_VOCABULARY}")
def m2_vocabulary(spark, sf_dir):
    return text.vocabulary(doc_tokens(spark, sf_dir).filter(F.size("tokens") >= 5))


@query(f"""select doc_id, len(any_value(tokens))::bigint as n_tokens, count(*) as n_terms from (select doc_id, tokens, unnest(tokens) as term from {_LONG})
where term in (select term from {_VOCABULARY}) group by doc_id""")
def m3_valid_docs(spark, sf_dir):
    docs = doc_tokens(spark, sf_dir)
    return text.valid_documents(docs, text.vocabulary(docs.filter(F.size("tokens") >= 5)), "doc_id")


# Change over time


_TURNOVER = """(with per as (select method, snapshot, 'node' as kind, node as a, '' as b from degrees union all select method, snapshot, 'edge', src, dst from edges),
 seen as (select p.method, t1, t2, kind, a, b, max((snapshot = t1)::int) as old, max((snapshot = t2)::int) as new from pairs p join per e on e.method = p.method and e.snapshot in (t1, t2) group by all)
select p.method, p.t1, p.t2, {} from pairs p left join seen s on s.method = p.method and s.t1 = p.t1 and s.t2 = p.t2 group by all)""".format(", ".join(
    f"coalesce(sum(old * new) filter (kind = '{k}'), 0)::double as {k[0]}b, (count(*) filter (kind = '{k}'))::double as {k[0]}a, coalesce(sum(new) filter (kind = '{k}'), 0)::double as {k[0]}2, coalesce(sum(old) filter (kind = '{k}'), 0)::double as {k[0]}1" for k in ("node", "edge")))


@query("select method, t1, t2, " + ", ".join(
    f"round(coalesce({k[0]}b / nullif({k[0]}a, 0), 0), 6)::double as {k}_jaccard, round(coalesce(({k[0]}a - {k[0]}b) / nullif({k[0]}a, 0), 0), 6)::double as {k}_turnover, ({k[0]}2 - {k[0]}b)::bigint as appearing_{k}s, ({k[0]}1 - {k[0]}b)::bigint as disappearing_{k}s" for k in ("node", "edge"))
    + f", round(case when ea = 0 then 0 else 1 - eb / ea end, 6)::double as volatility from {_TURNOVER}")
def g15_turnover(spark, sf_dir):
    return temporal.turnover(graph_edges(spark, sf_dir))


@query("""select a.yr as t1, b.yr as t2, round(1 - eb / nullif(a.n + b.n - eb, 0), 6)::double as volatility from
(select yr, count(*) as n, lead(yr) over (order by yr) as nxt from backbone group by yr) a join (select yr, count(*) as n from backbone group by yr) b on a.nxt = b.yr
join (select x.yr as y1, y.yr as y2, count(*)::double as eb from backbone x join backbone y on x.node_1 = y.node_1 and x.node_2 = y.node_2 group by all) c on c.y1 = a.yr and c.y2 = b.yr""")
def g16_volatility(spark, sf_dir):
    e = backbone_edges(spark, sf_dir).withColumnRenamed("yr", "snapshot").withColumn("method", F.lit("backbone"))
    return temporal.turnover(e).select("t1", "t2", "volatility")


# Static metrics


@query("select method, snapshot, num_nodes, num_edges, density::double as density from counts")
def g1_density(spark, sf_dir):
    return graphs.counts(graph_edges(spark, sf_dir))


_CLUSTERING = """select d.method, d.snapshot, round(avg(coalesce(2.0 * coalesce(t, 0) / nullif(degree * (degree - 1), 0), 0)), 6)::double as avg_clustering from degrees d
left join (select a.method, a.snapshot, a.u as node, count(*) as t from ways a join ways b on a.method = b.method and a.snapshot = b.snapshot and a.u = b.u and a.v < b.v
  join edges e on e.method = a.method and e.snapshot = a.snapshot and e.src = a.v and e.dst = b.v group by all) using (method, snapshot, node) group by all"""
_DEGREE = "select method, snapshot, node, round(coalesce(degree / nullif(num_nodes - 1, 0), 0), 6)::double as degree_centrality from degrees join counts using (method, snapshot)"


@query(_CLUSTERING)
def g5_clustering(spark, sf_dir):
    return graphs.clustering(graph_edges(spark, sf_dir))


@query(_DEGREE)
def g8_degree_centrality(spark, sf_dir):
    return graphs.degree_centrality(graph_edges(spark, sf_dir))


@query("""select method, snapshot, min(weight) as least, round(quantile_cont(weight, 0.25), 6) as q1, round(quantile_cont(weight, 0.5), 6) as median_weight,
round(quantile_cont(weight, 0.75), 6) as q3, max(weight) as most from edges group by all""")
def a20_median_weight(spark, sf_dir):
    return graphs.weight_summary(graph_edges(spark, sf_dir))


@query("select method, snapshot, (case when weight < 0 then 0 when weight >= 20 then 11 else 1 + floor(weight / 2) end)::bigint as bin, count(*) as n from edges group by all")
def k8_weight_histogram(spark, sf_dir):
    return graphs.weight_histogram(graph_edges(spark, sf_dir), 0, 20, 10)


_MODULARITY = """select yr, round(sum(w) / any_value(m) - sum(k * k) / (4 * any_value(m) * any_value(m)), 6)::double as modularity from
(select yr, c, sum(k) as k, sum(w) as w, sum(sum(k)) over (partition by yr) / 2 as m from
 (select e.yr, a.party as c, weighted::double as k, case when a.party = b.party then weighted else 0 end as w from backbone e join brand_meta a on e.node_1 = a.node join brand_meta b on e.node_2 = b.node
  union all select e.yr, b.party, weighted::double, 0 from backbone e join brand_meta b on e.node_2 = b.node) group by yr, c) group by yr"""


def _party_modularity(spark, sf_dir) -> DataFrame:
    parts = views.brand_meta(spark, sf_dir).select("node", F.col("party").alias("cluster"))
    return quality.modularity(backbone_edges(spark, sf_dir), parts, ["yr"])


@query(_MODULARITY)
def a16_modularity(spark, sf_dir):
    return _party_modularity(spark, sf_dir)


@query(f"""select 'party' as method, t1, t2, modularity_t1, modularity_t2, round(modularity_t2 - modularity_t1, 6) as modularity_change from
(select yr as t1, lead(yr) over (order by yr) as t2, modularity as modularity_t1, lead(modularity) over (order by yr) as modularity_t2 from ({_MODULARITY})) where t2 is not null""")
def g17_modularity_change(spark, sf_dir):
    return temporal.change(_party_modularity(spark, sf_dir).withColumn("method", F.lit("party")), "modularity", at="yr")


_TABLE = "(select source as cluster, lang as label, count(*)::double as n from documents where source is not null and lang is not null group by all)"


def _source_lang(spark, sf_dir) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    return quality.contingency(d.select(F.col("doc_id").alias("node"), F.col("source").alias("cluster")), d.select(F.col("doc_id").alias("node"), F.col("lang").alias("label")))


@query(f"select cluster, label, n::bigint as n from {_TABLE}")
def j11_contingency(spark, sf_dir):
    return _source_lang(spark, sf_dir)


@query(f"select round(sum(top) / sum(n), 6)::double as purity from (select max(n) as top, sum(n) as n from {_TABLE} group by cluster)")
def a14_purity(spark, sf_dir):
    return quality.purity(_source_lang(spark, sf_dir))


@query(f"""select round(greatest(0, mi / ((hu + hv) / 2)), 6)::double as nmi from
(select sum(n / t * ln(n * t / (a * b))) as mi from (select *, sum(n) over () as t, sum(n) over (partition by cluster) as a, sum(n) over (partition by label) as b from {_TABLE})),
(select -sum(a / t * ln(a / t)) as hu from (select sum(n) as a, sum(sum(n)) over () as t from {_TABLE} group by cluster)),
(select -sum(b / t * ln(b / t)) as hv from (select sum(n) as b, sum(sum(n)) over () as t from {_TABLE} group by label))""")
def a15_nmi(spark, sf_dir):
    return quality.nmi(_source_lang(spark, sf_dir))


# Link prediction


def _train(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = graph_edges(spark, sf_dir)
    return edges, cut(E.expanding_train(edges)), edges.groupBy("method", F.col("snapshot").alias("test")).agg(F.count("*").alias("n"))


@query("select method, test, src, dst, weight from train")
def l1_expanding_train(spark, sf_dir):
    return _train(spark, sf_dir)[1]


@query("select method, test, u, v from uniform")
def l2_uniform_negatives(spark, sf_dir):
    _, train, wanted = _train(spark, sf_dir)
    return links.uniform(train, wanted)


@query("select method, test, u, v from distance2")
def l3_distance2_negatives(spark, sf_dir):
    _, train, wanted = _train(spark, sf_dir)
    return links.distance_two(train, wanted)


@query("select method, test, u, v from hardest")
def l4_hard_negatives(spark, sf_dir):
    _, train, wanted = _train(spark, sf_dir)
    return links.hard(train, wanted)


def _scored(edges: DataFrame, train: DataFrame, wanted: DataFrame) -> DataFrame:
    tests = edges.withColumnRenamed("snapshot", "test").join(F.broadcast(train.select("method", "test").distinct()), ["method", "test"], "left_semi")
    return links.features(links.labelled_pairs(tests, links.uniform(train, wanted)), train)


def scored_pairs(spark, sf_dir) -> DataFrame:
    return _scored(*_train(spark, sf_dir))


@query("select method, test, u, v, label, cn from featured")
def l5_common_neighbours(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("method", "test", "u", "v", "label", "cn")


@query("select method, test, u, v, label, coalesce(jaccard0, 0)::double as jaccard from featured")
def l6_jaccard(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("method", "test", "u", "v", "label", F.round("jaccard", 6).alias("jaccard"))


@query("select method, test, u, v, label, round(aa, 6)::double as aa from featured")
def l7_adamic_adar(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("method", "test", "u", "v", "label", F.round("aa", 6).alias("aa"))


@query("select method, test, u, v, label, pa::bigint as pa from featured")
def l8_pref_attachment(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("method", "test", "u", "v", "label", "pa")


def _ranked(spark, sf_dir) -> DataFrame:
    return scored_pairs(spark, sf_dir).withColumn("score", F.col("cn").cast("double"))


@query("select method, test, round(sum(n * (tp - p / 2)) / nullif(sum(p) * sum(n), 0), 6)::double as auc from steps group by all")
def l9_auc(spark, sf_dir):
    return ranking.auc(_ranked(spark, sf_dir), links.KEYS)


@query("select method, test, round(sum(p * tp / (tp + fp)) / nullif(sum(p), 0), 6)::double as ap from steps group by all")
def l10_average_precision(spark, sf_dir):
    return ranking.average_precision(_ranked(spark, sf_dir), links.KEYS)


@query("""select method, test, """ + ", ".join(f"round(sum(label) filter (place <= {k}) / least({k}, count(*)), 6)::double as p_at_{k}, round(coalesce(sum(label) filter (place <= {k}) / nullif(sum(label), 0), 0), 6)::double as r_at_{k}" for k in (50, 100)) + """
from (select *, row_number() over (partition by method, test order by cn desc, u, v, label) as place from featured) group by method, test""")
def l11_precision_recall_at_k(spark, sf_dir):
    return ranking.at_k(_ranked(spark, sf_dir), links.KEYS)


@query("select method, test, u, v, label, cn, coalesce(jaccard0, 0)::double as jaccard, round(aa, 6)::double as aa, pa::bigint as pa from fitted")
def l13_training_rows(spark, sf_dir):
    """What each fold's model is fitted on: the edges of its train graph and as many uniform negatives."""
    rows = links.training_rows(_train(spark, sf_dir)[1])
    return rows.select("method", "test", "u", "v", "label", "cn", F.round("jaccard", 6).alias("jaccard"), F.round("aa", 6).alias("aa"), "pa")


@query()
def l13_logreg_scores(spark, sf_dir):
    edges, train, wanted = _train(spark, sf_dir)
    rows = _scored(edges, train, wanted)
    return links.logistic_scores(links.training_rows(train), rows).select("method", "test", "u", "v", "label", "score")


@query()
def l14_experiment_sweep(spark, sf_dir):
    """threshold, sampler, method, test and all ranking metrics of both scorers; thresholds are part of the method key."""
    base = graph_edges(spark, sf_dir)
    swept = [E.heavier(base, t).withColumn("method", F.concat_ws("|", "method", F.lit(str(t)))) for t in (5, 10, 20)]
    edges = swept[0].unionByName(swept[1]).unionByName(swept[2])
    train = cut(E.expanding_train(edges))
    wanted = edges.groupBy("method", F.col("snapshot").alias("test")).agg(F.count("*").alias("n"))
    tests = edges.withColumnRenamed("snapshot", "test").join(F.broadcast(train.select("method", "test").distinct()), ["method", "test"], "left_semi")
    keyed = None
    for name, sampler in links.SAMPLERS.items():
        rows = links.labelled_pairs(tests, sampler(train, wanted)).withColumn("sampler", F.lit(name))
        keyed = rows if keyed is None else keyed.unionByName(rows)
    rows = cut(links.features(keyed, train))
    scored = rows.withColumn("scorer", F.lit("cn")).withColumn("score", F.col("cn").cast("double"))
    fitted = links.logistic_scores(links.training_rows(train), rows).withColumn("scorer", F.lit("logreg"))
    return ranking.evaluate(scored.unionByName(fitted.select(*scored.columns)), ["method", "test", "sampler", "scorer"])


# Components and hops


@query("select method, snapshot, node, component from reach join grs using (gr)")
def g2_components(spark, sf_dir):
    return graphs.components(graph_edges(spark, sf_dir))


@query("select method, snapshot, l.component, l.size, l.size = (select count(*) from graph_nodes b where b.gr = l.gr) as is_connected from lcc l join grs using (gr)")
def g2_largest_component(spark, sf_dir):
    return graphs.largest_component(graphs.components(graph_edges(spark, sf_dir)))


_SOURCES = ("Brand#11", "Brand#12", "Brand#16", "Brand#20", "Brand#23")


def _hops(spark, sf_dir) -> DataFrame:
    e = kept(backbone_edges(spark, sf_dir), "backbone")  # sources and edges are both made of it
    sources = e.select("yr").distinct().withColumn("source", F.explode(F.array(*(F.lit(s) for s in _SOURCES))))
    return graphs.hop_distances(e, sources, ["yr"])


_IN = ", ".join(f"'{s}'" for s in _SOURCES)


@query(f"select yr, u as source, v as node, h::integer as hops from hops5 where u in ({_IN})")
def g19_hop_distance(spark, sf_dir):
    return _hops(spark, sf_dir)


@query(f"""select yr, u as source, target_group, round(avg(h), 6)::double as avg_hops, count(*) as n_reached from hops5
join (select node, party as target_group from brand_meta where party <> '' union all select node, 'gun' from brand_meta where gun = 1) t on t.node = v where h > 0 and u in ({_IN}) group by all""")
def g20_distance_panel(spark, sf_dir):
    return graphs.mean_hops(_hops(spark, sf_dir), graphs.target_groups(views.brand_meta(spark, sf_dir)), ["yr"])


# Weighted paths, centralities and communities of the whole graphs

_INSIDE = "dist5 d join lcc l on l.gr = d.gr join reach r on r.gr = d.gr and r.node = d.u and r.component = l.component"
_CLOSENESS = f"(select d.gr, d.u, round(coalesce((any_value(l.size) - 1) / nullif(sum(w), 0), 0), 6)::double as closeness from {_INSIDE} group by d.gr, d.u)"
_AVERAGE = f"(select d.gr, round(coalesce(sum(w) / nullif(any_value(l.size) * (any_value(l.size) - 1), 0), 0), 6)::double as avg_shortest_path, round(max(w), 6)::double as diameter from {_INSIDE} group by d.gr)"
_BETWEENNESS = """(select b.gr, b.u, round(coalesce(through, 0) / greatest((n - 1) * (n - 2), 1), 6)::double as betweenness from graph_nodes b
join (select gr, count(*) as n from graph_nodes group by gr) using (gr) left join through t on t.gr = b.gr and t.node = b.u)"""


def _distances(spark, sf_dir, between: bool = False) -> DataFrame:
    return paths.distance_metrics(graph_edges(spark, sf_dir), between=between)


@query(f"select method, snapshot, avg_shortest_path from {_AVERAGE} join grs using (gr)")
def g3_avg_shortest_path(spark, sf_dir):
    return paths.path_summary(_distances(spark, sf_dir)).select("method", "snapshot", "avg_shortest_path")


@query(f"select method, snapshot, diameter from {_AVERAGE} join grs using (gr)")
def g4_diameter(spark, sf_dir):
    return paths.path_summary(_distances(spark, sf_dir)).select("method", "snapshot", "diameter")


@query(f"select method, snapshot, b.u as node, closeness from graph_nodes b join grs using (gr) left join {_CLOSENESS} c on b.gr = c.gr and b.u = c.u")
def g10_closeness(spark, sf_dir):
    return _distances(spark, sf_dir).select("method", "snapshot", "node", "closeness")


@query(f"select method, snapshot, u as node, betweenness from {_BETWEENNESS} join grs using (gr)")
def g9_betweenness(spark, sf_dir):
    return _distances(spark, sf_dir, between=True).select("method", "snapshot", "node", "betweenness")


@query("select method, snapshot, b.u as node, round(x, 6) as eigenvector from graph_nodes b join grs using (gr) left join eigen e on e.gr = b.gr and e.u = b.u")
def g11_eigenvector(spark, sf_dir):
    return spectral.eigenvector(graph_edges(spark, sf_dir))


@query()
def g6_louvain(spark, sf_dir):
    return louvain.louvain(graph_edges(spark, sf_dir))


@query()
def g7_louvain_modularity(spark, sf_dir):
    e = graph_edges(spark, sf_dir)
    return quality.modularity(e, louvain.louvain(e))


@query(f"""select c.method, c.snapshot, num_nodes, num_edges, density::double as density, avg_clustering, avg_shortest_path, diameter, avg_betweenness, avg_closeness, avg_eigenvector, avg_degree, is_connected
from counts c join grs using (method, snapshot) join {_AVERAGE} p using (gr) join ({_CLUSTERING}) k using (method, snapshot)
join (select gr, round(avg(betweenness), 6) as avg_betweenness from {_BETWEENNESS} group by gr) b using (gr)
join (select gr, round(avg(closeness), 6) as avg_closeness from {_CLOSENESS} group by gr) n using (gr)
join (select gr, l.size = count(*) as is_connected from graph_nodes join lcc l using (gr) group by gr, l.size) s using (gr)
join (select method, snapshot, round(avg(degree_centrality), 6) as avg_degree from ({_DEGREE}) group by method, snapshot) d using (method, snapshot)
left join (select gr, round(avg(round(x, 6)), 6) as avg_eigenvector from eigen group by gr) e using (gr)""")
def g13_static_measures(spark, sf_dir):
    """The static record but for the modularity of communities, which SQL cannot find."""
    return graphs.static_record(graph_edges(spark, sf_dir), with_modularity=False)


@query()
def g13_static_record(spark, sf_dir):
    return graphs.static_record(graph_edges(spark, sf_dir))


# Topics and sentiment

LEXICON = (("the", "le", "der", "el", "and"), ("of", "et", "und", "que", "to"))


def _lexicon_score(column):
    return sentiment.lexicon_sentiment(column, *LEXICON)


def _count_sql(words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(list_filter(string_split_regex(lower(body_cleaned), '{text.SPACE}'), lambda t: t <> ''), lambda t: list_contains([{listed}], t)))"


@query(f"""select id, link_id, author, case when body_cleaned is not null and not {_BLANK} then sign({_count_sql(LEXICON[0])}::bigint - {_count_sql(LEXICON[1])}::bigint)::integer end as sentiment, body_cleaned from threads""")
def m15_direct_sentiment(spark, sf_dir):
    return sentiment.direct_sentiment(views.threads(spark, sf_dir), _lexicon_score)


def _vowels():
    """A scorer whose logits are the numbers of a, e and i."""
    import numpy as np

    return lambda texts: np.array([[t.count("a"), t.count("e"), t.count("i")] for t in texts], float)


_VOWEL_SQL = ", ".join(f"length(body_cleaned) - length(replace(body_cleaned, '{c}', ''))" for c in "aei")


@query(f"""select id, link_id, author, case when body_cleaned is not null and not {_BLANK} then list_position(n, list_max(n))::integer - 2 end as sentiment, body_cleaned
from (select *, [{_VOWEL_SQL}] as n from threads)""")
def f12_scored_sentiment(spark, sf_dir):
    """A batch scorer's logits through softmax, the likeliest label and its code."""
    return sentiment.direct_sentiment(views.threads(spark, sf_dir), sentiment.model_sentiment(_vowels))


@query()
def m1_lda_topics(spark, sf_dir):
    docs = doc_tokens(spark, sf_dir)
    return topics.TopicModel().fit(docs, "doc_id").assign(docs, "doc_id")


@query()
def m5_seeded_topics(spark, sf_dir):
    return topics.seeded_topics(views.table(spark, sf_dir, "documents"), "doc_id")


_GUIDES = [["the", "with"], ["der", "und"], ["les", "que"], ["los", "del"]]
_GUIDE_LABELS = ["english", "german", "french", "spanish"]


def _guided_sql(rounds: int = 5) -> str:
    """Spherical k-means with each round as a table of its own."""
    listed = ", ".join(f"('{w}', {k})" for k, words in enumerate(_GUIDES) for w in words)
    names = " ".join(f"when {k} then '{name}'" for k, name in enumerate(_GUIDE_LABELS))
    near = "select doc_id, arg_min(topic, (-s, topic)) as topic from (select doc_id, topic, round(sum(x * c), 9) as s from points join {} using (term) group by all) group by doc_id"
    unit = "select topic, term, c / sqrt(sum(c * c) over (partition by topic)) as c from ({})"
    steps = [f"c0 as ({unit.format('select topic, term, idf as c from words join idf using (term)')})", f"p0 as ({near.format('c0')})"]
    for k in range(1, rounds + 1):
        moved = unit.format(f"select topic, term, sum(x) as c from points join p{k - 1} using (doc_id) group by all")
        steps += [f"c{k} as ({moved} union all select * from c{k - 1} where topic not in (select topic from p{k - 1}))", f"p{k} as ({near.format(f'c{k}')})"]
    return f"""with toks as materialized (select doc_id, {_PLAIN} as tokens from documents), words(term, topic) as (values {listed}),
freq as (select term, count(*) as df from (select unnest(list_distinct(tokens)) as term from toks) group by term),
chosen as (select term from words union (select term from freq where df >= 3 order by df desc, term limit 3000)),
counted as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from toks) where term in (select term from chosen) group by all),
idf as (select term, ln((1.0::double + (select count(*) from toks)) / (1.0::double + count(*))) + 1.0 as idf from counted group by term),
points as materialized (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as x from (select doc_id, term, tf * idf as w from counted join idf using (term))),
{', '.join(s.replace(' as (', ' as materialized (', 1) for s in steps)},
large as (select topic from p{rounds} group by topic having count(*) >= 10)
select t.doc_id, coalesce(p.topic, case when len(tokens) = 0 then -2 else -1 end)::integer as topic_id, case p.topic {names} else 'OUTLIER' end as topic_label
from toks t left join (select * from p{rounds} where topic in (select topic from large)) p on t.doc_id = p.doc_id"""


@query(_guided_sql())
def m8_guided_topics(spark, sf_dir):
    return topics.guided_topics(views.table(spark, sf_dir, "documents"), "doc_id", _GUIDES, _GUIDE_LABELS, (), least_docs=10)


def _model() -> topics.TopicModel:
    return topics.TopicModel()


@query()
def m13_comment_topics(spark, sf_dir):
    return topics.comment_topics(views.threads(spark, sf_dir), _model(), STOP)


@query()
def a18_topic_counts(spark, sf_dir):
    return topics.comment_topics(views.threads(spark, sf_dir), _model(), STOP).groupBy("topic_id").agg(F.count("*").alias("n"))


@query()
def m14_sentiment_on_topics(spark, sf_dir):
    return sentiment.with_sentiment(m13_comment_topics(spark, sf_dir), _lexicon_score)


@query()
def m16_topics_and_sentiment(spark, sf_dir):
    return m14_sentiment_on_topics(spark, sf_dir).select("id", "link_id", "topic_id", "sentiment", "body_cleaned")


@query("select lang, round(len(list_intersect(w, ['the', 'der', 'les', 'los'])) / len(list_distinct(w || ['the', 'der', 'les', 'los'])), 6)::double as jaccard from (select lang, list(term order by n desc, term)[1:15] as w from (select lang, term, count(*) as n from (select lang, unnest(string_split(lower(text), ' ')) as term from documents where text is not null) group by all) group by lang)")
def f8_seed_jaccard(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").filter("text is not null")
    counts = d.select("lang", F.explode(F.split(F.lower("text"), " ")).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "term"))
    top = counts.withColumn("place", place).filter("place <= 15").groupBy("lang").agg(F.collect_set("term").alias("w"))
    return top.select("lang", F.round(jaccard(F.col("w"), F.array(*(F.lit(x) for x in ("the", "der", "les", "los")))), 6).alias("jaccard"))


# Embeddings


@query("""select a.vec_id as u, b.vec_id as v, round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 6)::double as score
from (select vec_id, label, embedding::double[] as e from embeddings) a join (select vec_id, label, embedding::double[] as e from embeddings) b on b.vec_id = a.vec_id + 1""")
def f11_cosine_pairs(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    a, b = e.select(F.col("vec_id").alias("u"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("v"), F.col("embedding").alias("y"))
    return a.join(b, F.col("v") == F.col("u") + 1).select("u", "v", F.round(cosine(F.col("x"), F.col("y")), 6).alias("score"))


@query()
def l15_node2vec(spark, sf_dir):
    """AUC and AP of cosine scores for every test snapshot of the sentiment graph and both samplers, each embedded on all before it."""
    edges, train, wanted = _train(spark, sf_dir)
    keep = lambda d: d.filter("method = 'sentiment'")
    train, tests, wanted = keep(train), keep(edges.withColumnRenamed("snapshot", "test")), keep(wanted)
    return embeddings.temporal_evaluation(train, tests, wanted)


@query("""select method, round(avg(auc), 6) as mean_auc, round(stddev_samp(auc), 6) as std_auc, round(avg(ap), 6) as mean_ap, round(stddev_samp(ap), 6) as std_ap from
(select method, test, round(sum(n * (tp - p / 2)) / nullif(sum(p) * sum(n), 0), 6)::double as auc, round(sum(p * tp / (tp + fp)) / nullif(sum(p), 0), 6)::double as ap from steps group by all) group by method""")
def l17_fold_summary(spark, sf_dir):
    """Mean and deviation of the common-neighbour metrics over test snapshots."""
    summary = ranking.mean_and_deviation(ranking.evaluate(_ranked(spark, sf_dir), links.KEYS), ["method"], ["auc", "ap"])
    return summary.select("method", *(F.round(c, 6).alias(c) for c in summary.columns[1:]))


@query("""select a.vec_id::varchar as u, (a.vec_id + 1)::varchar as v, round(coalesce(case when a.vec_id % 5 <> 0 then list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) end, 0), 6)::double as score
from (select vec_id, embedding::double[] as e from embeddings) a left join (select vec_id, embedding::double[] as e from embeddings where vec_id % 5 <> 0) b on b.vec_id = a.vec_id + 1""")
def l16_pair_cosine(spark, sf_dir):
    """Cosines of pairs of which some ends have no vector."""
    e = views.table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").cast("string").alias("u"), (F.col("vec_id") + 1).cast("string").alias("v"))
    vectors = e.filter("vec_id % 5 <> 0").select(F.col("vec_id").cast("string").alias("node"), F.col("embedding").alias("vector"))
    return embeddings.pair_cosine(pairs, vectors).select("u", "v", F.round("score", 6).alias("score"))


# More sources, filters and accessors


@query("select least(node_1, node_2) as node_1, greatest(node_1, node_2) as node_2, coalesce(weighted, 0)::bigint as weighted from networks")
def s7_network_view(spark, sf_dir):
    return readers.network_view(views.networks(spark, sf_dir), "weighted", 0)


@query("select id, author, community, score, snapshot from comments where author is not null and author <> '[deleted]' and community in (select community from meta where party <> '')")
def p3_allowed_communities(spark, sf_dir):
    allowed = views.meta(spark, sf_dir).filter("party <> ''")
    return interactions.clean_comments(views.comments(spark, sf_dir), allowed=allowed)


@query("select node, party as target_group from brand_meta where party in ('dem', 'rep') union all select node, 'gun' from brand_meta where gun = 1")
def p10_target_groups(spark, sf_dir):
    return graphs.target_groups(views.brand_meta(spark, sf_dir))


@query("select b.yr, b.node_1, b.node_2, b.weighted from backbone b where node_1 in (select node from strongest) and node_2 in (select node from strongest)")
def p11_edges_within_top10(spark, sf_dir):
    b = E.backbone(views.networks(spark, sf_dir)).withColumnsRenamed({"node_1": "src", "node_2": "dst"})
    return E.within(b, E.strongest(views.networks(spark, sf_dir)).select("node")).withColumnsRenamed({"src": "node_1", "dst": "node_2"})


@query("select method, src, dst, arg_max(weight, snapshot) as weight from edges group by method, src, dst")
def t3_composed_graph(spark, sf_dir):
    return E.compose(graph_edges(spark, sf_dir))


@query("select method, snapshot, node, degree, strength from degrees")
def a11_degrees(spark, sf_dir):
    return E.degrees(graph_edges(spark, sf_dir))


@query(f"""select method, snapshot, round(min(closeness), 6) as least, round(quantile_cont(closeness, 0.25), 6) as q1, round(quantile_cont(closeness, 0.5), 6) as median,
round(quantile_cont(closeness, 0.75), 6) as q3, round(max(closeness), 6) as most from {_CLOSENESS} join grs using (gr) group by method, snapshot""")
def k9_closeness_box(spark, sf_dir):
    return graphs.box(_distances(spark, sf_dir), "closeness", E.GRAPH)


@query(f"""select method, snapshot, round(avg(closeness), 6) as avg_closeness, round(avg(degree / nullif(n - 1, 0)), 6)::double as avg_degree from
(select b.gr, b.u, count(s.v) as degree, count(*) over (partition by b.gr) as n from graph_nodes b join graph_ways s on s.gr = b.gr and s.u = b.u group by b.gr, b.u) c join grs using (gr)
left join {_CLOSENESS} x on x.gr = c.gr and x.u = c.u group by method, snapshot""")
def a19_mean_centralities(spark, sf_dir):
    """Means over the nodes; those outside the largest component have no closeness and do not count in its mean."""
    e = graph_edges(spark, sf_dir)
    near = paths.distance_metrics(e, between=False).groupBy(*E.GRAPH).agg(F.round(F.avg("closeness"), 6).alias("avg_closeness"))
    d = E.degrees(e)
    share = F.col("degree") / (F.col("n") - 1)
    mean = d.join(d.groupBy(*E.GRAPH).agg(F.count("*").alias("n")), E.GRAPH).groupBy(*E.GRAPH).agg(F.round(F.avg(share), 6).alias("avg_degree"))
    return near.join(mean, E.GRAPH)


@query("""select method, snapshot, x, round(sum(c * exp(-power((x - w) / width, 2) / 2) / (n * width * sqrt(2 * pi()))), 6)::double as density from
(select method, snapshot, weight as w, count(*) as c from edges group by all) join
(select method, snapshot, count(*) as n, stddev_samp(weight) * power(count(*), -0.2) as width from edges group by all having stddev_samp(weight) > 0) using (method, snapshot),
(select unnest(range(0, 11))::double * 2 as x) group by all""")
def k8_weight_density(spark, sf_dir):
    return graphs.weight_density(graph_edges(spark, sf_dir), 0, 20, 11)


@query(f"""select source, min(avg_hops) as least, max(avg_hops) as most from (select yr, u as source, target_group, round(avg(h), 6)::double as avg_hops from hops5
join (select node, party as target_group from brand_meta where party <> '' union all select node, 'gun' from brand_meta where gun = 1) t on t.node = v where h > 0 and u in ({_IN}) group by all) group by source""")
def a21_distance_limits(spark, sf_dir):
    return g20_distance_panel(spark, sf_dir).groupBy("source").agg(F.min("avg_hops").alias("least"), F.max("avg_hops").alias("most"))


@query(f"""select yr, source, target_group, avg_hops, n_reached from (with panel as (select yr, u as source, target_group, round(avg(h), 6)::double as avg_hops, count(*) as n_reached from hops5
join (select node, party as target_group from brand_meta where party <> '' union all select node, 'gun' from brand_meta where gun = 1) t on t.node = v where h > 0 and u in ({_IN}) group by all)
select * from panel where yr between 1996 and 1999 and source in (select source from panel where yr between 1996 and 1999 group by source, target_group having count(distinct yr) = 4))""")
def f16_covered_panel(spark, sf_dir):
    return graphs.covered(g20_distance_panel(spark, sf_dir), {}, 1996, 1999)


@query("select t.method, t.test, count(*) as n_new from tests t join edges e on e.method = t.method and e.snapshot = t.test where not exists (select 1 from train r where r.method = t.method and r.test = t.test and r.src = e.src and r.dst = e.dst) and t.test > (select min(snapshot) from edges x where x.method = t.method) group by all")
def l1_new_test_edges(spark, sf_dir):
    edges, train, _ = _train(spark, sf_dir)
    tests = edges.withColumnRenamed("snapshot", "test").join(F.broadcast(train.select("method", "test").distinct()), ["method", "test"], "left_semi")
    pairs = links.labelled_pairs(tests, train.limit(0).withColumnsRenamed({"src": "u", "dst": "v"}), new_only=train)
    return pairs.groupBy("method", "test").agg(F.count("*").alias("n_new"))


@query()
def m11_topic_words(spark, sf_dir):
    return topics.TopicModel().fit(doc_tokens(spark, sf_dir), "doc_id").top_words(spark, 15)


@query("""with timed as (select case when user_id % 37 = 0 then '[deleted]' else cast(user_id as varchar) end as author, concat('k', json_extract_string(props, '$.k')) as community,
  cast(floor(value) as bigint) - 34 - 1 as s, cast(floor(epoch(ts) / 604800) as bigint) as week from events),
lean as (select week, author, community, sum(greatest(s, 0)) * sum((s > 0)::int) - sum(greatest(-s, 0)) * sum((s < 0)::int) as lean from timed
  where author <> '[deleted]' group by week, author, community)
select (a.week * 7)::bigint as day, a.community as src, b.community as dst, count(*) as weight from lean a join lean b on a.week = b.week and a.author = b.author and sign(a.lean) = sign(b.lean) and a.community < b.community
where a.lean <> 0 group by all""")
def g23_streamed_edges(spark, sf_dir):
    """The sentiment graph of every week, by a stream over the events that stops when it has read all; day counts from 1970.

    The stream appends the weeks that its watermark closes; those still open at the end of the table are computed in batch.
    """
    from ..streaming import interactions as streaming

    events = views.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the stream takes no path of a single file
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    columns = (
        F.timestamp_micros(seconds).alias("ts"),
        F.when(F.col("user_id") % 37 == 0, views.DELETED).otherwise(F.col("user_id").cast("string")).alias("author"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("community"),
        (F.floor("value").cast("long") - 34).alias("score"),
    )
    path = scratch(spark, "stream")
    streaming.append_windows(stream.select(*columns), f"{path}/out", f"{path}/state").awaitTermination()
    windows = spark.read.schema("snapshot timestamp, author string, community string, sentiment string").parquet(f"{path}/out")
    windows = streaming.with_open_windows(windows, events.select(*columns))
    return streaming.edges_of_windows(windows).select(F.floor(F.unix_seconds("snapshot") / 86400).cast("long").alias("day"), "src", "dst", "weight")
