"""Queries of lemmas, the grown polarity lexicon and the layout of networks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import kept
from ..operators import layout, lemmas, polarity, text
from ..sources import views
from .registry import query

#: Words as ``plain_tokens`` makes them, without stop words.
PLAIN = f"""list_filter(regexp_extract_all(regexp_replace(translate(lower(coalesce(text, '')), '{"".join(text._ACCENTED)}', '{"".join(text._ACCENTED.values())}'), '{text._MARK}', '', 'g'), '{text._LETTERS}'),
  lambda t: length(t) between 3 and 15 and not starts_with(t, '_'))"""


def _tokens(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.plain_tokens(F.col("text")).alias("tokens"))


def _strings(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CANDIDATES = " union all ".join(
    f"select term, n, concat(substr(term, 1, length(term) - {len(a)}), '{b}') as lemma from free where ends_with(term, '{a}')" for a, b in lemmas.NOUN_ENDINGS
)
_LEMMAS_SQL = f"""toks as materialized (select doc_id, {PLAIN} as tokens from documents),
known as materialized (select term, count(*) as n from (select unnest(tokens) as term from toks) group by term),
free as (select * from known where term not in ({_strings(lemmas.IRREGULAR)})), tried as ({_CANDIDATES}),
lemmas as materialized (select term, arg_min(lemma, (length(lemma), lemma)) as lemma, any_value(n) as n from tried where length(lemma) >= 3 and lemma in (select term from known where n >= 2) group by term
  union all select term, lemma, n from known join (values {", ".join(f"('{a}', '{b}')" for a, b in lemmas.IRREGULAR.items())}) i(term, lemma) using (term))"""


@query(f"with {_LEMMAS_SQL} select term, lemma, n from lemmas")
def f7_lemmas(spark, sf_dir):
    return lemmas.lemma_table(lemmas.words(_tokens(spark, sf_dir)))


@query(f"""with {_LEMMAS_SQL}, placed as (select doc_id, unnest(tokens) as term, generate_subscripts(tokens, 1) as pos from toks)
select t.doc_id, len(tokens)::bigint as n_tokens, coalesce(changed, 0)::bigint as n_changed, md5(coalesce(joined, '')) as tokens_md5 from toks t left join
(select doc_id, string_agg(coalesce(l.lemma, p.term), ' ' order by pos) as joined, count(l.lemma) as changed from placed p left join lemmas l using (term) group by doc_id) using (doc_id)""")
def f7_lemmatised_texts(spark, sf_dir):
    tokens = kept(_tokens(spark, sf_dir), "tokens")
    out = lemmas.lemmatise(tokens, kept(lemmas.lemma_table(lemmas.words(tokens)), "lemmas"), "doc_id")
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "n_changed", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


#: Seeds that the invented prose of the tables has.
SEEDS = {"best": 1, "good": 1, "great": 1, "thank": 1, "bad": -1, "stupid": -1, "idiot": -1, "loser": -1}


def _polarity_sql() -> str:
    fixed = ", ".join(f"('{w}', {1_000_000 * v})" for w, v in SEEDS.items())
    spans = " union all ".join(f"select tokens[i] as a, tokens[i + {d}] as b from placed where i + {d} <= len(tokens)" for d in range(1, polarity.WINDOW + 1))
    rounds = "".join(
        f""", s{k + 1} as materialized (select a as term, floor({polarity.DAMPING} * sum(weight * polarity)::double / any_value(whole) + 0.5)::bigint as polarity
  from graph join s{k} on b = term join whole using (a) where a not in (select term from s0) group by a having polarity <> 0 union all select * from s0)"""
        for k in range(polarity.ROUNDS)
    )
    return f"""toks as materialized (select doc_id, {PLAIN} as tokens from documents), placed as (select tokens, unnest(range(1, len(tokens) + 1)) as i from toks),
seen as materialized (select t, count(*) as n from (select unnest(tokens) as t from toks) group by t having n >= {polarity.LEAST_WORDS}),
met as (select least(a, b) as a, greatest(a, b) as b, count(*) as c from ({spans}) where a <> b group by all having c >= {polarity.LEAST_LINKS}),
links as materialized (select m.a, m.b, floor(ln(c * (select sum(n)::double from seen) / x.n / y.n) * 1e6 + 0.5)::bigint as weight from met m join seen x on x.t = m.a join seen y on y.t = m.b),
graph as materialized (select a, b, weight from links where weight > 0 union all select b, a, weight from links where weight > 0),
whole as materialized (select a, sum(weight) as whole from graph group by a), s0(term, polarity) as (values {fixed}){rounds}"""


def _lexicon(tokens):
    return polarity.grow(polarity.word_graph(tokens), SEEDS)


@query(f"with {_polarity_sql()} select term, polarity::bigint as polarity from s{polarity.ROUNDS}")
def m12_polarity_lexicon(spark, sf_dir):
    return _lexicon(kept(_tokens(spark, sf_dir), "tokens"))


@query(f"""with {_polarity_sql()}, signed as (select doc_id, tokens[i] as term, case when len(list_intersect(tokens[greatest(i - {polarity.SCOPE}, 1):i - 1], [{_strings(polarity.NEGATIONS)}])) > 0 then -1 else 1 end as sign
  from (select doc_id, tokens, unnest(range(1, len(tokens) + 1)) as i from toks))
select t.doc_id, coalesce(score, 0)::bigint as score, sign(coalesce(score, 0))::integer as sentiment from toks t left join
(select doc_id, sum(sign * polarity) as score from signed join s{polarity.ROUNDS} using (term) group by doc_id) using (doc_id)""")
def m12_polarity_scores(spark, sf_dir):
    tokens = kept(_tokens(spark, sf_dir), "tokens")
    return polarity.scores(tokens, _lexicon(tokens), "doc_id")


_LAYOUT_ROUNDS = 12


def _layout_sql(rounds: int = _LAYOUT_ROUNDS) -> str:
    """Each round as tables of its own."""
    hexed = ", ".join(f"floor(('0x' || {layout.first_place(p)})::bigint / 16777216::double * 1e6 + 0.5) / 1e6 as {a}" for p, a in ((1, "x"), (7, "y")))
    parts = [
        "ways as (select yr, node_1 as src, node_2 as dst, weighted::double as weight from networks union all select yr, node_2, node_1, weighted::double from networks)",
        f"at0 as (select yr, node, {hexed} from (select distinct yr, src as node from ways))",
    ]
    own = "(c.cell = p.cell)::int"
    for k, step in enumerate(layout.steps(rounds)):
        parts += [
            f"box{k} as (select yr, count(*) as n, min(x) as low_x, min(y) as low_y, greatest(max(x) - min(x), 1e-6) as wide, greatest(max(y) - min(y), 1e-6) as high from at{k} group by yr)",
            f"placed{k} as (select *, {layout.CELL} as cell, {layout.COARSE.format('x')} as qx, {layout.COARSE.format('y')} as qy from at{k} join box{k} using (yr))",
            f"cells{k} as (select yr, cell, count(*) as m, sum(qx)::bigint as sx, sum(qy)::bigint as sy from placed{k} group by all)",
            f"""pushed{k} as (select yr, node, sum({layout.push('x')})::bigint as px, sum({layout.push('y')})::bigint as py from (select p.yr, node, x, y, n, c.m - {own} as m, c.sx - {own} * qx as sx, c.sy - {own} * qy as sy
  from placed{k} p join cells{k} c using (yr)) where m > 0 group by yr, node)""",
            f"""pulled{k} as (select yr, src as node, sum({layout.pull('x')})::bigint as lx, sum({layout.pull('y')})::bigint as ly from (select w.yr, src, weight, n, p.x, p.y, q.x as x2, q.y as y2
  from ways w join placed{k} p on p.yr = w.yr and p.node = src join at{k} q on q.yr = w.yr and q.node = dst) group by yr, src)""",
            f"""at{k + 1} as (select yr, node, {layout.moved('x', step)} as x, {layout.moved('y', step)} as y from (select yr, node, x, y, coalesce(px, 0) + lx as fx, coalesce(py, 0) + ly as fy
  from at{k} left join pushed{k} using (yr, node) join pulled{k} using (yr, node)))""",
        ]
    parts += [
        f"middle as (select yr, count(*) as n, sum({layout.COARSE.format('x')})::bigint as sx, sum({layout.COARSE.format('y')})::bigint as sy from at{rounds} group by yr)",
        f"centred as (select yr, node, x - sx / 1e6 / n as x, y - sy / 1e6 / n as y from at{rounds} join middle using (yr))",
    ]
    named = ", ".join(p.replace(" as (", " as materialized (", 1) for p in parts)
    return f"""select * from (with {named} select yr, node, round(case when far > 0 then x / far else 0 end, 4) as x, round(case when far > 0 then y / far else 0 end, 4) as y
from centred join (select yr, max(greatest(abs(x), abs(y))) as far from centred group by yr) using (yr))"""


@query(_layout_sql())
def k10_network_layout(spark, sf_dir):
    """Positions of the brands in every year's whole network."""
    n = views.networks(spark, sf_dir).select("yr", F.col("node_1").alias("src"), F.col("node_2").alias("dst"), F.col("weighted").alias("weight"))
    return layout.spring_layout(n, ["yr"], _LAYOUT_ROUNDS)
