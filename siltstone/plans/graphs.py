"""Graph queries.  Cyclic graph: a user's events in order, as transitions between nodes user:type:tens of k.  Acyclic graph:
a customer's orders in order, each linked to the next and to the next with the same priority."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import graph as G
from siltstone.plans.registry import K, Tables, k_of, query


def transitions(t: Tables):
    e = t.events.select("user_id", "ts", "event_id", F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.floor(k_of() / 10).cast("string")).alias("node"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edges = e.withColumn("dst", F.lead("node").over(w)).filter("dst is not null and dst <> node").select(F.col("node").alias("src"), "dst").distinct()
    return e.select("node").distinct(), edges


CYCLIC = f"""v as (select user_id, ts, event_id, user_id || ':' || event_type || ':' || ({K} // 10) node from events),
x as (select node src, lead(node) over (partition by user_id order by ts, event_id) dst from v), e as (select distinct src, dst from x where dst is not null and src <> dst), n as (select distinct node from v)"""
CLOSURE = "c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src)"
SCC = "s as (select n.node, least(n.node, coalesce(min(a.dst), n.node)) component from n left join (select a.src, a.dst from c a join c b on a.src = b.dst and a.dst = b.src) a on a.src = n.node group by n.node)"


def orders(t: Tables):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    same = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    o = t.orders.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(by).alias("a"), F.lead("o_orderkey").over(same).alias("b"))
    edges = o.select("src", F.col("a").alias("dst")).union(o.select("src", F.col("b").alias("dst"))).filter("dst is not null").distinct()
    return t.orders.select(F.col("o_orderkey").alias("node")), edges


ACYCLIC = """o as (select o_orderkey src, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) a, lead(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) b from orders),
e as (select src, a dst from o where a is not null union select src, b from o where b is not null)"""


def _starts(nodes):
    return nodes.filter("node like '%:signup:0'")


@query(f"with recursive {CYCLIC}, r as (select node from n where node like '%:signup:0' union select e.dst from r join e on r.node = e.src) select node from r")
def reachable(t):
    nodes, edges = transitions(t)
    return G.reachable(edges, _starts(nodes))


@query(f"""with recursive {CYCLIC}, r as (select node from n where node like '%:signup:0' union select e.dst from r join e on r.node = e.src),
z as (select node from n where node like '%:purchase:%'), f as (select src, dst from e where src not in (select node from z)),
b as (select node from r where node in (select node from z) union select e.src from b join e on b.node = e.dst)
select src, dst from f where src in (select node from r) and src in (select node from b) and dst in (select node from r) and dst in (select node from b)""")
def chains(t):
    nodes, edges = transitions(t)
    return G.chains(edges, _starts(nodes), nodes.filter("node like '%:purchase:%'"))


@query(f"with recursive {ACYCLIC}, d as (select o_orderkey node, 0 depth from orders where o_orderkey not in (select dst from e) union select e.dst, depth + 1 from d join e on d.node = e.src) select node, max(depth) depth from d group by 1")
def layers_dag(t):
    nodes, edges = orders(t)
    return G.longest_path(nodes, edges)


@query(f"with recursive {CYCLIC}, {CLOSURE}, {SCC} select node, component from s")
def scc_members(t):
    return G.strong_components(*transitions(t))


@query(f"""with recursive {CYCLIC}, {CLOSURE}, {SCC}, big as (select component from s group by 1 having count(*) > 1),
late as (select s.node from s where component in (select component from big) union select c.dst from c join s on s.node = c.src where component in (select component from big)),
f as (select * from e where src not in (select node from late) and dst not in (select node from late)),
d as (select node, 0 depth from n where node not in (select node from late) and node not in (select dst from f) union select f.dst, depth + 1 from d join f on d.node = f.src),
early as (select node, max(depth) layer from d group by 1),
g as (select distinct a.component src, b.component dst from e join s a on a.node = e.src join s b on b.node = e.dst where e.src in (select node from late) and e.dst in (select node from late) and a.component <> b.component),
h as (select distinct component node, 0 depth from s where node in (select node from late) and component not in (select dst from g) union select g.dst, depth + 1 from h join g on h.node = g.src),
m as (select s.node, s.component, max(h.depth) + coalesce((select max(layer) + 1 from early), 0) layer from s join h on h.node = s.component where s.node in (select node from late) group by 1, 2)
select node, layer, false cycle_resolution from early union all
select node, layer, layer in (select layer from m where component in (select component from big)) from m""")
def layers_cyclic(t):
    nodes, edges = transitions(t)
    return G.layers(nodes, edges)


@query(f"with {CYCLIC}, p as (select node from n where node not like '%:view:%'), b as (select distinct dst from e where src in (select node from p)), f as (select node from p where node not in (select dst from b)) select node from f union all select min(node) from p where not exists (select 1 from f) having min(node) is not null")
def frontier_first_round(t):
    nodes, edges = transitions(t)
    return G.frontier(nodes.filter("node not like '%:view:%'"), edges, ["node"])
