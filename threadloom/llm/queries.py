"""Queries over the operators of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat_format, conversation_repair, html_extraction, license_scan, mixing, near_dups, phrase_mining, sentence_pieces, topk_search, toxicity, url_filter, warc
from .oracle_texts import HTML_SQL, PHRASES_SQL, REPAIR_SQL

#: Rules of the URL query.
RULES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Path of the public SentencePiece model; installed alike on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.best_licence(license_scan.scan_licences(_table(spark, sf_dir, "documents")))


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")).df)


def near_dups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", (toxicity.remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest_segments(chat_format.format_turns(turns), in_order=True)


def ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(_table(spark, sf_dir, "documents")))


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest_encoding(sentence_pieces.encode_documents(_table(spark, sf_dir, "documents"), piece_model()))


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), RULES)


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.fit(pages))


def repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(conversation_repair.faults(damaged))


def phrases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(_table(spark, sf_dir, "documents"), least=10, percent=50, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": license_query,
    "op2_topk_search": topk_query,
    "op3_warc_bundles": warc_query,
    "op4_minhash_dedup": near_dups_query,
    "op5_toxicity": toxicity_query,
    "op6_chat_format": chat_query,
    "op7_multi_index_hashing": ann_query,
    "op8_source_mixing": mixing_query,
    "op9_sentence_pieces": pieces_query,
    "op10_url_filter": url_query,
    "op11_html_extraction": html_query,
    "op12_conversation_repair": repair_query,
    "op13_phrase_mining": phrases_query,
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    values = ", ".join(f"({k}, {_text(name)}, {_text(text)})" for k, (name, text) in enumerate(license_scan.TEMPLATES))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = "list_filter(string_split_regex({x}, '[ \\n]+'), lambda t: t <> '')"
    plain = "regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g')"
    return f"""
with named(no, licence, x) as (values {values}),
cut as (select no, licence, {words.format(x=plain.format(x="x"))} as w from named),
templates as (select no, licence, len(w) as n, {grams} as tg from cut),
plain as (select doc_id, {plain.format(x="coalesce(text, '')")} as t from documents),
units as (select doc_id, unnest([t] || string_split(t, chr(10)) || string_split_regex(t, '\\n *\\n')) as u from plain),
whole as materialized (select doc_id, {words.format(x="t")} as w from plain),
sharing as (select doc_id, no from (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from whole) join (select no, len(tg) as n, unnest(tg) as g from templates) using (g)
            group by doc_id, no having count(*) >= any_value(n) * {license_scan.THRESHOLD} / {2 - license_scan.THRESHOLD} - 1e-9),
placed as (select doc_id, no, tg, w, n, unnest(range(1, len(w) - n + 2)) as p from sharing join whole using (doc_id) join templates using (no) where len(w) >= n),
near as (select doc_id, no, p, run, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) as dice from
         (select doc_id, no, p, tg, run, {grams.replace("w[", "run[").replace("len(w)", "len(run)")} as g from (select *, w[p:p + n - 1] as run from placed))),
runs as (select arg_min(run, (-dice, p)) as w, doc_id from near where dice >= {license_scan.THRESHOLD} group by doc_id, no),
worded as (select doc_id, {words.format(x="u")} as w from units union select doc_id, w from runs),
sized as (select doc_id, w, {grams} as g from worded where len(w) > 1),
scored as (select doc_id, w, licence, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) as dice
           from sized join templates on len(g) <= len(tg) * {2 - license_scan.THRESHOLD} / {license_scan.THRESHOLD} + 1
                                     and len(tg) <= len(g) * {2 - license_scan.THRESHOLD} / {license_scan.THRESHOLD} + 1),
best as (select doc_id, w, max(dice) as dice from scored where dice >= {license_scan.THRESHOLD} group by doc_id, w),
top as (select s.doc_id, s.w, s.dice, min(s.licence) as licence from scored s join best b on s.doc_id = b.doc_id and s.w = b.w and s.dice = b.dice group by all),
per as (select doc_id, count(*) as n_matches, max(dice) as dice, string_agg(distinct licence, ',' order by licence) as licences from top group by doc_id),
named_best as (select t.doc_id, min(t.licence) as licence from top t join per p on t.doc_id = p.doc_id and t.dice = p.dice group by t.doc_id)
select d.doc_id, coalesce(n_matches, 0)::bigint as n_matches, licence, round(coalesce(dice, 0.0), 6)::double as dice, coalesce(licences, '') as licences
from documents d left join per p on d.doc_id = p.doc_id left join named_best b on d.doc_id = b.doc_id"""


def _chat_sql() -> str:
    t = chat_format.Template()
    escaped = "replace(text, '\\', '\\\\')"
    for c in t.controls():
        escaped = f"replace({escaped}, {_text(c)}, {_text(c[0] + chr(92) + c[1:])})"
    opening = "case role " + " ".join(f"when {_text(r)} then {len(t.opening(r))}" for r in t.titles) + f" else {len(t.opening(''))} end"
    after = " ".join(f"when {_text(r)} then {_text(','.join(sorted(t.order[r])))}" for r in t.titles)
    start = ",".join(sorted(t.order[chat_format.START]))
    return f"""
with given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
stated as (select *, lag(role) over (partition by conv_id order by turn, role, text) as before from given),
turns as (select *, not list_contains(string_split(case before {after} else '{start}' end, ','), role) as bad from stated)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({opening} + length({escaped}) + {len(t.close_mark + t.after)})::bigint as formatted_chars,
  sum(bad::int)::bigint as violations
from turns group by conv_id"""


def _url_sql() -> str:
    rules = ", ".join(f"({_text(r.pattern)}, {_text(r.host)}, {_text(r.path)}, {_text(r.verdict)})" for r in RULES)
    host = "translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, {host} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from cut),
rules(rule, rhost, rpath, verdict) as (values {rules}),
fits as (select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts p left join fits f on p.page_id = f.page_id"""


_TOPK_SQL = """
with rows as (select vec_id, min(embedding) as v from embeddings
    where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) group by vec_id),
ints as (select vec_id, list_transform(v, lambda x: floor(256 * x::double)) as v from rows),
scored as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
    from ints q join ints d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5"""

_BITS = "(unhex(sha1(payload))::bit)::varchar"
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{16 >> k} * substr(bits, (5 * i + {k + 1})::bigint, 1)::integer" for k in range(5)) + ", 1)), '')"
_WARC_SQL = f"""
with given as (select page_id, coalesce(html, '') as payload from pages),
bits as (select page_id, payload, {_BITS} as bits, max(page_id) over (partition by payload) as top from given)
select page_id, strlen(payload)::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from bits"""

#: Links are found by all pairs here; fit for small tables only.
_NEAR_SQL = """
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
sets as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
same as (select min(doc_id) as rep, s from (select doc_id, list_sort(s) as s from sets) where len(s) > 0 group by s),
posts as (select rep, unnest(s) as g from same),
shared as (select a.rep as a, b.rep as b, count(*) as n from posts a join posts b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep),
sizes as (select rep, len(s) as n from same),
links as (select a, b from shared s join sizes x on s.a = x.rep join sizes y on s.b = y.rep where 100 * s.n >= 75 * (x.n + y.n - s.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select rep as node, rep as seen from same union select r.node, l.b from reach r join both_ways l on r.seen = l.a),
least as (select node, min(seen) as component from reach group by node),
members as (select d.doc_id, len(d.s) as n, l.component from (select doc_id, list_sort(s) as s from sets) d left join same m on d.s = m.s left join least l on m.rep = l.node)
select doc_id, n::bigint as n_shingles, coalesce(component, doc_id) as component_id, doc_id = coalesce(component, doc_id) as kept from members"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op2_topk_search": _TOPK_SQL,
    "op3_warc_bundles": _WARC_SQL,
    "op4_minhash_dedup": _NEAR_SQL,
    "op6_chat_format": _chat_sql(),
    "op10_url_filter": _url_sql(),
    "op11_html_extraction": HTML_SQL,
    "op12_conversation_repair": REPAIR_SQL,
    "op13_phrase_mining": PHRASES_SQL,
}
