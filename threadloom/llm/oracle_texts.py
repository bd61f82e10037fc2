"""DuckDB SQL of the queries over pages, conversations and phrases."""

from __future__ import annotations

#: Takes the article by its own mark, where the operator finds it by scores; fit for pages with one plain ``article`` each.
HTML_SQL = r"""
with found as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') as a from pages),
spaced as (select page_id, url, regexp_replace(replace(regexp_replace(a, '</?(p|h1)>', chr(30), 'g'), '<br>', ' '), '<[^>]*>', '', 'g') as a from found),
decoded as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') as a from spaced),
cut as (select page_id, url, list_transform(string_split(a, chr(30)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) as b from decoded),
texts as (select page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) as text from cut)
select page_id, url, text, length(text)::bigint as n_chars from texts"""

#: The cheapest audit row by row: all states of the grammar after each row, each with its least (cost, audit).
REPAIR_SQL = r"""
with recursive bytes as (select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i)),
crc as (select list(c order by i) as tab from bytes),
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hit as (select conv_id, turn, role, text,
  xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as h from given, crc),
left_over as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
  case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy from hit where h <> 0),
placed as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as t from left_over),
numbered as (select *, row_number() over (partition by conv_id, role, text order by i) as nth from placed),
judged as (select *, case when t = '' then 1 when nth > 1 then 2 when right(t, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
  lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from numbered),
counted as (select conv_id, count(*) as n, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
  count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from judged group by conv_id),
everyone as (select distinct conv_id from conversations),
totals as (select e.conv_id, coalesce(n, 0) as n, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal
  from everyone e left join counted c on e.conv_id is not distinct from c.conv_id),
after(state, initial, target) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
given_role(state, target, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserted(state, target, cost, audit, lines) as (values (0, 0, 0, '', null), (1, 1, 0, '', null), (2, 2, 0, '', null), (3, 3, 0, '', null), (0, 2, 5, 'I', 'user:'), (1, 2, 5, 'I', 'user:'),
  (2, 3, 5, 'I', 'assistant:'), (3, 2, 5, 'I', 'user:'), (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:')),
moves as (
  select conv_id, i, state, state as target, 2 as cost, 'D' as letter, null as line from judged, (select unnest(range(4)) as state)
  union all select conv_id, i, a.state, a.target, case when fault = 3 then 5 else 0 end, 'K', role || ':' || text from judged j join after a on left(j.role, 1) = a.initial where fault not in (1, 2)
  union all select conv_id, i, g.state, g.target, case when fault = 3 then 6 else 1 end, 'R', g.role || ':' || text from judged j, given_role g where fault not in (1, 2)),
walk as (
  select conv_id, 0::bigint as i, target as state, cost, audit, lines from totals, inserted where state = 0
  union all
  select conv_id, i, state, cost, audit, lines from (
    select w.conv_id, w.i + 1 as i, x.target as state, w.cost + m.cost + x.cost as cost, w.audit || m.letter || x.audit as audit, nullif(concat_ws(chr(10), w.lines, m.line, x.lines), '') as lines
    from walk w join moves m on m.conv_id is not distinct from w.conv_id and m.i = w.i + 1 and m.state = w.state join inserted x on x.state = m.target)
  qualify row_number() over (partition by conv_id, state order by cost, audit) = 1),
ended as (select t.*, w.cost, w.audit, w.lines, row_number() over (partition by t.conv_id order by w.cost, w.audit) as best
  from totals t join walk w on w.conv_id is not distinct from t.conv_id and w.i = t.n where w.state in (0, 3))
select conv_id, gaps::bigint as gaps, blank::bigint as blank, duplicate::bigint as duplicate, truncated::bigint as truncated, illegal::bigint as illegal,
  cost::bigint as cost, audit, sha256(coalesce(lines, '')) as repaired_sha256 from ended where best = 1"""

PHRASES_SQL = r"""
with given as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\f\r]')) as p from given),
cut as (select lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') as w from pieces),
words as (select lang, unnest(w) as x from cut),
one as (select lang, x, count(*) as f from words group by lang, x),
total as (select lang, sum(f)::bigint as n from one group by lang),
pairs as (select lang, unnest(list_transform(range(1, len(w)), lambda i: {'x': w[i], 'y': w[i + 1]})) as g from cut where len(w) > 1),
two as (select lang, g.x as x, g.y as y, count(*) as f from pairs group by lang, g.x, g.y having count(*) >= 10),
triples as (select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: {'x': w[i], 'y': w[i + 1], 'z': w[i + 2]})) as g from cut where len(w) > 2),
three as (select lang, g.x as x, g.y as y, g.z as z, count(*) as f from triples group by lang, g.x, g.y, g.z having count(*) >= 10),
inner_pairs as (select lang, x, y, f from three union all select lang, y, z, f from three),
longer as (select lang, x, y, max(f) as f from inner_pairs group by lang, x, y),
cuts as (
  select p.lang, p.x || ' ' || p.y as phrase, p.f as a, 1 as k, l.f as l, r.f as r
  from two p join one l on l.lang = p.lang and l.x = p.x join one r on r.lang = p.lang and r.x = p.y left join longer o on o.lang = p.lang and o.x = p.x and o.y = p.y
  where o.f is null or 100 * o.f < 50 * p.f
  union all select p.lang, p.x || ' ' || p.y || ' ' || p.z, p.f, 1, l.f, r.f from three p join one l on l.lang = p.lang and l.x = p.x join two r on r.lang = p.lang and r.x = p.y and r.y = p.z
  union all select p.lang, p.x || ' ' || p.y || ' ' || p.z, p.f, 2, l.f, r.f from three p join two l on l.lang = p.lang and l.x = p.x and l.y = p.y join one r on r.lang = p.lang and r.x = p.z),
scored as (select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from cuts),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as low from scored),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest where low = 1)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000"""
