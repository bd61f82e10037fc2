"""The domain tables as DuckDB common table expressions, put before the queries that name them."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "comments": """select event_id as id, case when user_id % 37 = 0 then '[deleted]' else cast(user_id as varchar) end as author,
  concat('k', json_extract_string(props, '$.k')) as community, cast(floor(value) as bigint) - 34 as score,
  cast(floor((day(ts) - 1) / 7) as bigint) as snapshot from events""",
    "bots": "select distinct cast(user_id as varchar) as author from events where user_id % 50 = 7",
    "clean": "select * from comments c where author <> '[deleted]' and not exists (select 1 from bots b where b.author = c.author)",
    "activity": "select snapshot, author, community, count(*) as n from clean group by all",
    "leaning": """select snapshot, author, community,
  sum(case when s > 0 then 1 else 0 end)::bigint as num_pos, sum(case when s < 0 then 1 else 0 end)::bigint as num_neg,
  sum(greatest(s, 0))::bigint as sum_pos_scores, sum(greatest(-s, 0))::bigint as sum_neg_scores, count(*) as total_comments
  from (select *, coalesce(score, 0) - 1 as s from clean) group by snapshot, author, community""",
    "summary": """select *, case when sum_pos_scores * num_pos > sum_neg_scores * num_neg then 'Positive'
  when sum_pos_scores * num_pos < sum_neg_scores * num_neg then 'Negative' else 'Neutral' end as sentiment from leaning""",
    "g22": """select a.snapshot, a.community as src, b.community as dst, count(*) as weight from activity a join activity b
  on a.snapshot = b.snapshot and a.author = b.author and a.community < b.community group by all""",
    "g23": """select a.snapshot, a.community as src, b.community as dst, count(*) as weight from summary a join summary b
  on a.snapshot = b.snapshot and a.author = b.author and a.sentiment = b.sentiment and a.community < b.community
  where a.sentiment <> 'Neutral' group by all""",
    "edges": """select 'cocomment' as method, snapshot, src, dst, weight::double as weight from g22
  union all select 'sentiment', snapshot, src, dst, weight::double from g23""",
    "bought": """select distinct o_custkey as author, p_brand as node, cast(year(o_orderdate) as bigint) as yr
  from orders join lineitem on o_orderkey = l_orderkey join part on p_partkey = l_partkey""",
    "networks": """select yr, node_1, node_2, weighted, case when rank() over (partition by yr order by weighted desc) <= 40 then 1 else 0 end as unweighted
  from (select a.yr, a.node as node_1, b.node as node_2, count(*) as weighted from bought a join bought b
    on a.author = b.author and a.yr = b.yr and a.node < b.node group by a.yr, a.node, b.node)""",
    "backbone": "select yr, node_1, node_2, case when weighted > 0 then weighted end as weighted from networks where unweighted = 1",
    "ends": "select yr, node_1 as node, weighted from networks union all select yr, node_2, weighted from networks",
    "strength": "select node, sum(weighted)::bigint as strength, round(avg(weighted), 6) as mean_weight from ends group by node",
    "strongest": "select row_number() over (order by strength desc, node)::integer as place, node, strength from strength qualify place <= 10",
    "threads": """select concat('m', conv_id, '_', turn) as id, concat('t', conv_id) as link_id,
  case when turn = 0 then concat('t', conv_id) else concat('m', conv_id, '_', turn - 1) end as parent_id,
  role as author, text as body_cleaned, turn as pos from conversations""",
    "meta": """select community, case n % 3 when 0 then 'dem' when 1 then 'rep' else '' end as party, case when n % 7 = 0 then 1 else 0 end as banned,
  case when n % 5 = 0 then 1 else 0 end as gun from (select distinct community, cast(substr(community, 2) as bigint) as n from comments)""",
    "brand_meta": """select node, case n % 3 when 0 then 'dem' when 1 then 'rep' else '' end as party, case when n % 7 = 0 then 1 else 0 end as banned,
  case when n % 5 = 0 then 1 else 0 end as gun from (select distinct p_brand as node, cast(substr(p_brand, 7) as bigint) as n from part)""",
    "ways": "select method, snapshot, src as u, dst as v, weight from edges union all select method, snapshot, dst, src, weight from edges",
    "degrees": "select method, snapshot, u as node, count(*) as degree, sum(weight) as strength from ways group by all",
    "counts": """select method, snapshot, n.num_nodes, m.num_edges, round(coalesce(2.0 * num_edges / nullif(num_nodes * (num_nodes - 1), 0), 0), 6) as density
  from (select method, snapshot, count(*) as num_nodes from degrees group by all) n
  join (select method, snapshot, count(*) as num_edges from edges group by all) m using (method, snapshot)""",
    "pairs": "select e.method, t1, t2 from (select distinct method from edges) e cross join (select snapshot as t1, lead(snapshot) over (order by snapshot) as t2 from (select distinct snapshot from edges)) where t2 is not null",
    # train graphs: the latest weight of every pair among earlier snapshots
    "tests": "select distinct method, snapshot as test from edges",
    "train": """select t.method, t.test, e.src, e.dst, arg_max(e.weight, e.snapshot) as weight
  from tests t join edges e on e.method = t.method and e.snapshot < t.test group by all""",
    "tends": "select method, test, src as u, dst as v from train union all select method, test, dst, src from train",
    "tdeg": "select method, test, u, count(*) as d from tends group by all",
    "tnodes": "select distinct method, test, u from tends",
    "wanted": "select method, snapshot as test, count(*) as n from edges group by all",
    "tcn": """select a.method, a.test, a.v as u, b.v as v, count(*) as cn, coalesce(sum(case when d.d > 1 then 1 / ln(d.d) end), 0) as aa
  from tends a join tends b on a.method = b.method and a.test = b.test and a.u = b.u and a.v < b.v
  join tdeg d on d.method = a.method and d.test = a.test and d.u = a.u group by all""",
    "distance2": """select c.method, c.test, u, v from tcn c join wanted w using (method, test)
  where not exists (select 1 from train t where t.method = c.method and t.test = c.test and t.src = c.u and t.dst = c.v)
  qualify row_number() over (partition by c.method, c.test order by md5(u || '|' || v || '|42'), u, v) <= any_value(w.n) over (partition by c.method, c.test)""",
    "sharing": """select method, test, u, v, cn from tcn c
  where not exists (select 1 from train t where t.method = c.method and t.test = c.test and t.src = c.u and t.dst = c.v)""",
    "lacking": """select w.method, w.test, w.n - coalesce(c, 0) as n from wanted w join (select distinct method, test from train) using (method, test)
  left join (select method, test, count(*) as c from sharing group by all) using (method, test) where w.n > coalesce(c, 0)""",
    "hardest": """select method, test, u, v from (select s.*, w.n, row_number() over (partition by s.method, s.test order by cn desc, md5(u || '|' || v || '|42'), u, v) as place
    from sharing s join wanted w using (method, test)) where place <= n
  union all select method, test, u, v from filled""",
    "tm": "select method, test, count(*) as n from train group by all",
    "linked": "select method, test, src as u, dst as v from train",
    "linked_or_sharing": "select * from linked union all select method, test, u, v from sharing",
    "labelled": """select e.method, e.snapshot as test, src as u, dst as v, 1 as label from edges e join (select distinct method, test from train) t on t.method = e.method and t.test = e.snapshot
  union all select method, test, u, v, 0 from uniform""",
    "steps": """select method, test, cn, sum(label) as p, sum(1 - label) as n,
    sum(sum(label)) over w as tp, sum(sum(1 - label)) over w as fp
  from featured group by method, test, cn window w as (partition by method, test order by cn desc rows unbounded preceding)""",
    "spans": "select yr, node_1 as u, node_2 as v, weighted::double as w from backbone union all select yr, node_2, node_1, weighted::double from backbone",
    "bnodes": "select distinct yr, u from spans",
}


def _sample(name: str, wanted: str, barred: str, seed: int) -> None:
    """Views of a uniform sample of the pairs that are not barred: all pairs in their order of visits, then the first."""
    VIEWS[f"nodes_{name}"] = f"select method, test, u, row_number() over (partition by method, test order by md5(u || '|{seed}'), u) - 1 as i, count(*) over (partition by method, test) as size from tnodes"
    VIEWS[f"visits_{name}"] = f"""select method, test, size, x, (x * 2147483647) % (size * (size - 1) // 2) as t
  from (select method, test, size, unnest(range(0, size * (size - 1) // 2)) as x from (select distinct method, test, size from nodes_{name}))"""
    VIEWS[name] = f"""select method, test, u, v from (select d.method, d.test, least(a.u, b.u) as u, greatest(a.u, b.u) as v, w.n, row_number() over (partition by d.method, d.test order by x) as place
    from visits_{name} d join nodes_{name} a on a.method = d.method and a.test = d.test and a.i = t % d.size
    join nodes_{name} b on b.method = d.method and b.test = d.test and b.i = (t % d.size + t // d.size + 1) % d.size
    join {wanted} w on w.method = d.method and w.test = d.test
    where not exists (select 1 from {barred} l where l.method = d.method and l.test = d.test and l.u = least(a.u, b.u) and l.v = greatest(a.u, b.u))) where place <= n"""


_sample("uniform", "wanted", "linked", 42)
_sample("filled", "lacking", "linked_or_sharing", 42)
_sample("fitting", "tm", "linked", 43)
for _name, _pairs in (("featured", "labelled"), ("fitted", "(select method, test, u, v, 1 as label from linked union all select method, test, u, v, 0 from fitting)")):
    VIEWS[_name] = f"""select l.*, coalesce(c.cn, 0) as cn, round(coalesce(c.cn, 0) / nullif(coalesce(a.d, 0) + coalesce(b.d, 0) - coalesce(c.cn, 0), 0), 6) as jaccard0,
    coalesce(c.aa, 0) as aa, coalesce(a.d, 0) * coalesce(b.d, 0) as pa
  from {_pairs} l left join tcn c on c.method = l.method and c.test = l.test and c.u = l.u and c.v = l.v
  left join tdeg a on a.method = l.method and a.test = l.test and a.u = l.u left join tdeg b on b.method = l.method and b.test = l.test and b.u = l.v"""
#: Hops in the yearly backbone, likewise by doubling.
for _k in range(1, 6):
    VIEWS[f"hops{_k}"] = f"select a.yr, a.u, b.v, min(a.h + b.h) as h from hops{_k - 1} a join hops{_k - 1} b on a.yr = b.yr and a.v = b.u group by all"
VIEWS["hops0"] = "select yr, u, v, min(h) as h from (select yr, u, v, 1 as h from spans union all select yr, u, u, 0 from bnodes) group by all"
#: Shortest distances in the whole graphs (gr: method and snapshot) by doubling: after five rounds, over up to 32 hops.
VIEWS["grs"] = "select distinct method, snapshot, method || '|' || snapshot as gr from ways"
VIEWS["graph_ways"] = "select method || '|' || snapshot as gr, u, v, weight::double as w from ways"
VIEWS["graph_nodes"] = "select distinct gr, u from graph_ways"
VIEWS["dist0"] = "select gr, u, v, min(w) as w from (select * from graph_ways union all select gr, u, u, 0 from graph_nodes) group by all"
for _k in range(1, 6):
    VIEWS[f"dist{_k}"] = f"select a.gr, a.u, b.v, round(min(a.w + b.w), 9) as w from dist{_k - 1} a join dist{_k - 1} b on a.gr = b.gr and a.v = b.u group by all"
VIEWS["reach"] = "select gr, u as node, min(v) as component, count(*) as size from dist5 group by gr, u"
#: Shortest paths by number of edges, summed to path counts, and what passes through a node.
VIEWS["steps_on"] = "select a.gr, a.u as s, e.u, e.v from dist5 a join graph_ways e on e.gr = a.gr and e.u = a.v join dist5 b on b.gr = a.gr and b.u = a.u and b.v = e.v where abs(a.w + e.w - b.w) < 1e-9"
VIEWS["path_counts"] = """with recursive p as (select gr, u as s, u as t, 0 as k, 1::double as c from graph_nodes
  union all select p.gr, p.s, e.v, p.k + 1, sum(p.c) from p join steps_on e on e.gr = p.gr and e.s = p.s and e.u = p.t group by p.gr, p.s, e.v, p.k)
  select gr, s, t, sum(c) as c from p group by all"""
VIEWS["through"] = """select a.gr, a.t as node, sum(a.c * b.c / w.c) as through from path_counts a join path_counts b on b.gr = a.gr and b.s = a.t
  join path_counts w on w.gr = a.gr and w.s = a.s and w.t = b.t join dist5 x on x.gr = a.gr and x.u = a.s and x.v = a.t join dist5 y on y.gr = a.gr and y.u = b.s and y.v = b.t
  join dist5 z on z.gr = a.gr and z.u = a.s and z.v = b.t where a.s <> a.t and b.s <> b.t and a.s <> b.t and abs(x.w + y.w - z.w) < 1e-9 group by a.gr, a.t"""
VIEWS["lcc"] = """select gr, component, size from (select gr, component, count(*) as size from reach group by all)
  qualify row_number() over (partition by gr order by size desc, component) = 1"""
#: Power iteration in the largest components; every node is its own neighbour once, which is the shift by the identity.
VIEWS["core"] = "select r.gr, r.node, l.size from reach r join lcc l on l.gr = r.gr and l.component = r.component"
VIEWS["core_ends"] = "select s.gr, s.u, s.v, s.w, c.size from graph_ways s join core c on c.gr = s.gr and c.node = s.u union all select gr, node, node, 1.0, size from core"
VIEWS["eigen"] = """with recursive r as (select gr, node as u, 0 as k, 1.0::double / size as x, false as done from core
  union all select gr, u, k + 1, x, sum(abs(x - old)) over (partition by gr) < size * 1e-3 from
   (select gr, u, k, size, old, raw / sqrt(sum(raw * raw) over (partition by gr)) as x from
    (select r.gr, e.u, r.k, e.size, sum(e.w * r.x) as raw, sum(case when e.u = e.v then r.x end) as old
     from r join core_ends e on e.gr = r.gr and e.v = r.u where not r.done and r.k < 1000 group by r.gr, e.u, r.k, e.size)))
  select gr, u, x from r where done"""


def with_views(body: str) -> str:
    """The query with the views it uses, directly or through others, in order of need."""
    order: list[str] = []

    def need(name: str) -> None:
        text = VIEWS[name]
        for other in VIEWS:
            if other != name and other not in order and re.search(rf"(from|join)\s+{other}\b", text):
                need(other)
        if name not in order:
            order.append(name)

    used = [n for n in VIEWS if re.search(rf"(from|join)\s+{n}\b", body)]
    for name in used:
        need(name)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order) + "\n" + body
