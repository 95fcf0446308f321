"""Queries over rules on plans, mentions and inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import mentions as M
from siltstone.operators import plan_rules as P
from siltstone.operators import relations as R
from siltstone.plans.registry import query


@query(r"""with e as (select p_brand b, p_partkey "at", replace(p_name, ' ', '.') || ' (' || lower(p_type) || ') s::' || p_size as line from part),
w as (select distinct b, 'm::' || word as name, [word] as plain, [] as parts from (select p_brand b, unnest(string_split(p_name, ' ')) word from part)
  union select distinct p_brand, 's::' || p_size, [p_size::varchar, 'brass'], ['s::' || p_size] from part),
h as (select w.b, w.name, e."at", e.line from w join e using (b) where contains(line, name) or len(list_filter(plain, lambda n: regexp_matches(line, '(^|[^A-Za-z0-9_])' || n || '($|[^A-Za-z0-9_])'))) > 0)
select b as p_brand, name, min("at") as "at", arg_min(line, "at") as line from h group by 1, 2""")
def first_callee_mention(t):
    """A brand's parts as the entries of a list; the first that mentions a name, its tail or an alias of it."""
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(" ("), F.lower("p_type"), F.lit(") s::"), F.col("p_size").cast("string"))
    entries = t.part.select("p_brand", F.col("p_partkey").alias("at"), line.alias("line"))
    words = t.part.select("p_brand", F.explode(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("m::"), w))).alias("name"), F.array().cast("array<string>").alias("aliases"))
    sizes = t.part.select("p_brand", F.concat(F.lit("s::"), F.col("p_size").cast("string")).alias("name"), F.array(F.lit("brass")).alias("aliases"))
    wanted = words.unionByName(sizes).distinct().withColumn("names", M.match_names(F.col("name"), F.col("aliases")))
    return M.first_mentions(entries, wanted, "p_brand")


@query("""with recursive o as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) "at", l_returnflag f, l_linestatus s, l_quantity q from lineitem),
t as (select k, row_number() over (partition by k order by case when k % 3 = 0 then -"at" else "at" end) i, f, s from o where q > 25),
r as (select distinct k, 0::bigint i, 0::bigint as last from o union all
  select k, i, last from (select r.k, t.i, min(o."at") as last from r join t on t.k = r.k and t.i = r.i + 1 left join o on o.k = r.k and o."at" > r.last and o.f = t.f and o.s = t.s where r.last is not null group by 1, 2))
select k as l_orderkey, bool_and(last is not null) covered from r group by 1""")
def inventory_coverage(t):
    """Two inventories of an order's lines, the second a part of the first and in every third order backwards."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    ours = t.lineitem.select("l_orderkey", place.alias("at"), F.concat(F.lit("C::"), "l_returnflag", F.lit("_"), place.cast("string")).alias("ident"), F.concat("l_linestatus", F.lit("\r\n")).alias("body"), "l_quantity")
    back = F.when(F.col("l_orderkey") % 3 == 0, -F.col("at")).otherwise(F.col("at"))
    theirs = ours.filter("l_quantity > 25").select("l_orderkey", back.alias("at"), F.regexp_extract("ident", "::(.)", 1).alias("ident"), F.regexp_replace("body", "\r\n", "\n").alias("body"))
    return R.ordered_coverage(ours, theirs, "l_orderkey")


@query("""with c as (select c_custkey k, c_custkey % 7 r, c_nationkey n, c_name from customer),
f as (select k, r, n, unnest(range(0, n)) i from c)
select k as plan, [0, 1, i]::int[] as "at", 'phases[0].modules[1] (''m' || n || ''').source_files[' || i || '] must be a string' as message from f where r in (0, 1) and i % 5 = k % 5
union all select k, []::int[], case r when 2 then 'phases.json is not valid JSON' when 3 then 'the top-level value must be an object' else 'top-level field "phases" must be an array' end from c where r in (2, 3, 4)
union all select k, [i]::int[], case i % 3 when 0 then 'phases[' || i || '] must be an object' else 'phases[' || i || '].modules must be an array' end from f where r = 5 and i % 3 < 2
union all select k, [0, i]::int[], case i % 3 when 0 then 'phases[0].modules[' || i || '] must be an object' when 1 then 'phases[0].modules[' || i || '] ("' || c_name || '''s").source_files is missing' else 'phases[0].modules[' || i || '].source_files must be an array' end from f join c using (k, r, n) where r = 6""")
def plan_violations(t):
    """A plan a customer, whole, broken at one place or at many; a row for each message."""
    items = lambda f: F.array_join(F.transform(F.when(F.col("c_nationkey") > 0, F.sequence(F.lit(0), F.col("c_nationkey") - 1)).otherwise(F.array().cast("array<int>")), f), ",")
    kind = F.col("c_custkey") % 7
    files = items(lambda i: F.when(i % 5 == F.col("c_custkey") % 5, "3").otherwise('"a.py"'))
    phases = items(lambda i: F.when(i % 3 == 0, "7").when(i % 3 == 1, '{"modules": {}}').otherwise('{"modules": []}'))
    modules = items(lambda i: F.when(i % 3 == 0, "null").when(i % 3 == 1, F.concat(F.lit('{"name": "'), "c_name", F.lit("'s\"}"))).otherwise('{"source_files": "x"}'))
    plan = (
        F.when(kind <= 1, F.concat(F.lit('{"phases": [{"modules": [{"source_files": []}, {"name": "m'), F.col("c_nationkey").cast("string"), F.lit('", "source_files": ['), files, F.lit("]}]}]}")))
        .when(kind == 2, F.concat(F.lit("{"), "c_name")).when(kind == 3, F.concat(F.lit('["'), "c_name", F.lit('"]'))).when(kind == 4, F.concat(F.lit('{"phases": "'), "c_name", F.lit('"}')))
        .when(kind == 5, F.concat(F.lit('{"phases": ['), phases, F.lit("]}"))).otherwise(F.concat(F.lit('{"phases": [{"modules": ['), modules, F.lit("]}]}")))
    )
    return P.violations(t.customer.select(F.col("c_custkey").alias("plan"), plan.alias("json")))
