"""Queries over the star schema and pages: joins, sets, roll-ups, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import aggregates as A
from siltstone.operators import ordered as O
from siltstone.operators import relations as R
from siltstone.operators import reports as S
from siltstone.plans.registry import query


@query("""select coalesce(l_returnflag, 'TOTAL') l_returnflag, round(sum(l_quantity), 2) input, round(sum(l_extendedprice), 2) as output, round(sum(l_discount), 2) cache_read, round(sum(l_tax), 2) cache_write
from lineitem group by rollup (l_returnflag)""")
def token_rollup_total(t):
    sums = {n: F.round(F.sum(c), 2) for n, c in (("input", "l_quantity"), ("output", "l_extendedprice"), ("cache_read", "l_discount"), ("cache_write", "l_tax"))}
    return A.rollup_total(t.lineitem, "l_returnflag", sums)


@query("""with p as (select p_brand k, min(p_retailprice) price from part where p_size > 10 group by 1),
m as (select p_partkey, case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then 'vendor/' || p_brand else 'unknown' end model from part),
x as (select m.*, coalesce(a.price, b.price) price from m left join p a on a.k = m.model left join p b on b.k = case when contains(m.model, '/') then substr(m.model, instr(m.model, '/') + 1) end)
select model, count(*) calls, round(sum(coalesce(price, 0.0)), 4) cost_or_zero, case when bool_and(price is not null) then round(sum(price), 4) end cost_or_null from x group by 1""")
def cost_with_price_fallback(t):
    model = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("vendor/"), "p_brand")).otherwise("unknown")
    priced = R.price_lookup(t.part.select("p_partkey", model.alias("model")), "model", t.part.filter("p_size > 10").select("p_brand", F.col("p_retailprice").alias("price")), "p_brand", "price")
    return priced.groupBy("model").agg(
        F.count("*").alias("calls"), F.round(F.sum(F.coalesce("price", F.lit(0.0))), 4).alias("cost_or_zero"),
        F.when(F.bool_and(F.col("price").isNotNull()), F.round(F.sum("price"), 4)).alias("cost_or_null"),
    )


@query("""with c as (select c_nationkey k, count(*) calls from customer group by 1),
r as (select c_nationkey k, count(*) filter (st = 'confirmed') confirmed, count(*) filter (st <> 'confirmed') not_confirmed, count(*) results
 from (select c_nationkey, case o_orderstatus when 'F' then 'confirmed' when 'O' then 'not_confirmed' else 'error' end st from orders join customer on o_custkey = c_custkey where o_totalprice > 300000) group by 1)
select c.k c_nationkey, coalesce(confirmed, 0) confirmed, coalesce(not_confirmed, 0) not_confirmed, greatest(0, calls - coalesce(results, 0)) pending from c left join r using (k)""")
def bug_counts_pending(t):
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "not_confirmed").otherwise("error")
    results = t.orders.filter("o_totalprice > 300000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", status.alias("st"))
    return A.outcome_counts(results, t.customer, "c_nationkey", "st")


@query("""with g as (select o_custkey, count(*) n, min(o_totalprice) a, max(o_totalprice) b from orders group by 1)
select o_custkey, n samples, round_even(case when n = 1 then a * 0.75 else a * 0.9 end, 9) low, round_even(case when n = 1 then b * 1.25 else b * 1.1 end, 9) high,
 greatest(0, floor(round_even(case when n = 1 then a * 0.75 else a * 0.9 end, 9)))::bigint low_whole, greatest(1, ceil(round_even(case when n = 1 then b * 1.25 else b * 1.1 end, 9)))::bigint high_whole,
 round(least(10.0, greatest(0.1, n / 10.0)), 6) as scale from g""")
def historical_range(t):
    real = A.historical_range(t.orders, ["o_custkey"], "o_totalprice")
    whole = A.historical_range(t.orders, ["o_custkey"], "o_totalprice", True).select("o_custkey", F.col("low").cast("long").alias("low_whole"), F.col("high").cast("long").alias("high_whole"))
    return real.join(whole, "o_custkey").withColumn("scale", F.round(A.scale_factor(F.col("samples"), F.lit(10), F.lit(0), F.lit(0)), 6))


OLD, NEW = "o_orderstatus <> 'P'", "o_orderpriority <> '5-LOW'"
DIFF = f"""(select coalesce(o.o_orderkey, n.o_orderkey) o_orderkey, case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' when o.p <> n.p then 'modified' end as change
from (select o_orderkey, o_totalprice p from orders where {OLD}) o full join (select o_orderkey, case when o_orderpriority = '1-URGENT' then o_totalprice + 1 else o_totalprice end p from orders where {NEW}) n on o.o_orderkey = n.o_orderkey)"""


def _diff(t):
    """Two revisions of orders, which differ by rows and by prices."""
    old = t.orders.filter(OLD).select("o_orderkey", F.col("o_totalprice").alias("p"))
    new = t.orders.filter(NEW).select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("p"))
    return R.revision_diff(old, new, ["o_orderkey"], F.col("p"))


@query(f"select * from {DIFF} where change is not null")
def revision_diff(t):
    return _diff(t)


@query(f"select change, count(*) n from {DIFF} where change is not null group by 1")
def change_counts(t):
    return _diff(t).groupBy("change").agg(F.count("*").alias("n"))


@query("select l_returnflag, sum(case when l_linestatus = 'O' then l_linenumber else 1 end)::bigint mismatches from lineitem group by 1")
def conditional_mismatch_sum(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber")).otherwise(1)).alias("mismatches"))


@query("select kind, count(*) total, count(*) filter (contains(lower(title), '00001')) shown from (select 'customer' kind, c_name title from customer union all select 'supplier', s_name from supplier) group by 1")
def report_kind_counts(t):
    rows = t.customer.select(F.lit("customer").alias("kind"), F.col("c_name").alias("title")).unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_name").alias("title")))
    return A.kind_counts(rows, "kind", X.search(" 00001 ", "title"))


@query("""with x as (select l_suppkey s, l_partkey p, l_shipmode_ n, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey i from (select *, l_returnflag || l_linestatus l_shipmode_ from lineitem)),
d as (select s, p, n, min(i) i from x group by all)
select s l_suppkey, p l_partkey, arg_min(n, i) first_name, string_agg(n, ',' order by i) names from d group by 1, 2""")
def edge_merge_ordered(t):
    at = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")
    rows = t.lineitem.select("l_suppkey", "l_partkey", at.alias("i"), F.concat("l_returnflag", "l_linestatus").alias("n"), F.concat("l_returnflag", "l_linestatus").alias("first_name"))
    return A.merge_edges(rows, ["l_suppkey", "l_partkey"], "i", "first_name", "n").select("l_suppkey", "l_partkey", "first_name", F.array_join("n", ",").alias("names"))


@query("""select count(*) n, sum(l_partkey)::bigint parts, located from (select distinct l_orderkey, l_linenumber, l_partkey, true located from lineitem where l_linenumber > 1
union all select l_orderkey, l_linenumber, l_partkey, false from lineitem where l_linenumber <= 1) group by located""")
def callsite_dedup(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    out = A.dedupe_located(rows, ["l_orderkey", "l_linenumber", "l_partkey"], F.col("l_linenumber") > 1)
    return out.groupBy((F.col("l_linenumber") > 1).alias("located")).agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("select s l_suppkey, string_agg(p::varchar, ',' order by p) neighbours from (select distinct l_suppkey s, l_partkey p from lineitem) group by 1")
def adjacency_lists(t):
    return A.adjacency(t.lineitem, "l_suppkey", "l_partkey").select("l_suppkey", F.array_join("neighbours", ",").alias("neighbours"))


PATH = r"regexp_replace(url, '^[a-z]+://[^/]*/?', '')"


@query(f"""with p as (select distinct {PATH} path from pages where {PATH} <> '') select path from p a where not exists (select 1 from p b where b.path <> '.' and starts_with(a.path, b.path || '/'))""")
def minimal_prefixes(t):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return A.minimal_prefixes(t.pages.select(path.alias("path")).filter("path <> ''"), "path")


@query("select l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) l_orderkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) l_linenumber from lineitem group by 1")
def first_owner(t):
    return A.first_owner(t.lineitem, "l_partkey", ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@query("select s_nationkey, s_suppkey, s_acctbal from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) n from supplier) where n = 1")
def best_row_per_name(t):
    return O.top_k(t.supplier, ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], 1).select("s_nationkey", "s_suppkey", "s_acctbal")


@query("select n_nationkey, row_number() over (order by n_nationkey) as number from nation where n_regionkey <> 1")
def compact_renumber(t):
    return O.renumber(t.nation.filter("n_regionkey <> 1").select("n_nationkey"), "n_nationkey")


@query("""with b as (select p_brand, p_partkey, ((row_number() over (partition by p_brand order by p_partkey) - 1) // 2)::int batch from part)
select p_brand, count(distinct batch) batches, count(*) functions, max(batch) + 1 last_batch from b group by 1""")
def fixed_batches(t):
    b = O.fixed_batches(t.part, ["p_brand"], ["p_partkey"], 2)
    return b.groupBy("p_brand").agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("functions"), (F.max("batch") + 1).alias("last_batch"))


@query("select o_custkey, o_orderkey, o_totalprice, n as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n from orders) where n <= 5")
def topk_per_group(t):
    return O.top_k(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def global_topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 else 99 end status_rank from orders")
def status_rank_order(t):
    return t.orders.select("o_orderkey", O.rank_in(F.col("o_orderstatus"), ["F", "O"]).alias("status_rank"))


@query("""with n as (select n_regionkey, list(n_name order by n_name) l from nation group by 1)
select n_regionkey, array_to_string(l[1:3], ', ') || case when len(l) > 3 then ' +' || (len(l) - 3) else '' end names from n""")
def overflow_list(t):
    names = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return names.select("n_regionkey", O.overflow(F.col("l"), 3).alias("names"))


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def semi_known(t):
    return t.orders.join(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderpriority = '1-URGENT')")
def anti_external(t):
    """Customers without an urgent order."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return R.stale(t.customer.select("c_custkey"), urgent, ["c_custkey"])


@query("select distinct l_suppkey src, l_partkey dst from lineitem where l_suppkey in (select p_partkey from part where p_size < 25) and l_partkey in (select p_partkey from part where p_size < 25)")
def in_phase_edges(t):
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return R.within(edges, "src", "dst", t.part.filter("p_size < 25").select("p_partkey"), "p_partkey").select("src", "dst")


@query("""select distinct caller, callee from (
select l_suppkey caller, l_partkey callee from lineitem where l_quantity > 49
union all select l_suppkey, p_partkey from part join lineitem on p_brand = 'Brand#' || (l_linenumber * 11) where l_quantity < 2 and p_size = 1)
where callee in (select p_partkey from part) and caller <> callee""")
def supplemental_edges(t):
    exact = t.lineitem.filter("l_quantity > 49").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"))
    by_name = t.part.filter("p_size = 1").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("callee"))
    names = t.lineitem.filter("l_quantity < 2").select(F.col("l_suppkey").alias("caller"), F.concat(F.lit("Brand#"), (F.col("l_linenumber") * 11).cast("string")).alias("name")).distinct()
    return R.supplemental_edges(exact, by_name, names, t.part.select(F.col("p_partkey").alias("callee")))


@query("""select l_orderkey, l_partkey, coalesce(case when l_linenumber > 1 then l_linenumber end, o_custkey)::bigint line, n_name, r_name
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'""")
def ctor_chain(t):
    """Call site, class, container and constructor, with the line of the site or else of its owner."""
    line = F.coalesce(F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")), F.col("o_custkey")).cast("long")
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("l_orderkey", "l_partkey", line.alias("line"), "n_name", "r_name")
    )


@query("""select d.doc_id, case when l.doc_id is not null and l.toxic >= 0 and l.quality = 1 then case when toxic = 1 then 'confirmed' else 'not_confirmed' end else 'pending' end status,
case when l.doc_id is null then 'missing_or_invalid_result' when quality <> 1 then 'invalid_result' end reason from documents d left join labels l using (doc_id)""")
def candidate_pending(t):
    labels = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "confirmed").otherwise("not_confirmed").alias("status"), "quality")
    return R.pending_rows(t.documents.select("doc_id"), labels, "doc_id", "status", F.col("quality") == 1)


@query("select count(*) total_reported, count(*) filter (toxic = 1) total_confirmed, count(*) filter (toxic = 0) total_not_confirmed, count(*) filter (l.doc_id is null) total_pending from documents d left join labels l using (doc_id)")
def validation_summary(t):
    bugs = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(F.when(F.col("toxic") == 1, "confirmed").when(F.col("toxic") == 0, "not_confirmed").otherwise("pending").alias("status"))
    return S.summary(bugs).drop("total_error")


@query("select doc_id, source from documents join labels using (doc_id) where toxic = 1")
def confirmed_only(t):
    return t.documents.join(t.labels.filter("toxic = 1"), "doc_id").select("doc_id", "source")


@query("""select b.o_orderkey, count(*) earlier, max(a.o_totalprice) best from orders b join orders a on a.o_custkey = b.o_custkey and a.o_orderdate < b.o_orderdate group by 1""")
def earlier_layer_context(t):
    """What earlier orders of the same customer there are."""
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return O.earlier(t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), ["o_custkey"], at, "o_totalprice").filter("earlier > 0").select("o_orderkey", "earlier", "best")


@query("""with w as (select p_partkey, unnest(string_split(p_name, ' ')) word, unnest(range(1, len(string_split(p_name, ' ')) + 1)) pos from part), v as (select distinct lower(split_part(p_type, ' ', 1)) name from part)
select p_partkey, arg_min(word, pos) word, min(pos)::int pos from w join v on lower(word) = name group by 1""")
def name_mention_first(t):
    words = t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word")).withColumn("pos", F.col("i") + 1)
    names = t.part.select(F.lower(F.split("p_type", " ")[0]).alias("name")).distinct()
    return words.join(names, F.lower("word") == F.col("name")).groupBy("p_partkey").agg(F.min_by("word", "pos").alias("word"), F.min("pos").alias("pos"))


@query("""with n as (select distinct case when p_partkey % 2 = 0 then p_name else p_name || '_' || (p_partkey % 5) end as name from part),
i as (select p_partkey item, unnest([p_name, p_brand || '::' || p_name]) k from part), f as (select distinct name, item from n join i on name = k),
s as (select distinct name, item from n join i on regexp_replace(name, '_[0-9]+$', '') = k where name not in (select name from f)) select name, item from f union select name, item from s""")
def dual_key_lookup(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws("_", "p_name", (F.col("p_partkey") % 5).cast("string")))
    keys = F.array("p_name", F.concat_ws("::", "p_brand", "p_name"))
    return R.dual_key(t.part.select(name.alias("name")).distinct(), "name", t.part.select(F.col("p_partkey").alias("item"), "p_name", "p_brand"), "item", keys)


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' and c_custkey is not null or c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def relevant_any(t):
    chosen = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return R.relevant(t.customer, "c_custkey", chosen, t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))).select("c_custkey")


@query("select distinct a.p_partkey caller, b.p_partkey callee from part a join part b on lower(a.p_name) = lower(b.p_name) and a.p_partkey <> b.p_partkey where a.p_size <= 10")
def ci_name_resolve(t):
    a = t.part.filter("p_size <= 10").select(F.col("p_partkey").alias("caller"), F.lower("p_name").alias("name"))
    return R.resolve_call_sites(a, t.part.select(F.col("p_partkey").alias("callee"), F.lower("p_name").alias("name")), [])


@query("""with n as (select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 i from supplier),
w as (select distinct s_suppkey % 4 i, s_nationkey from supplier) select w.s_nationkey, w.i as wanted, n.s_suppkey from w left join n on n.s_nationkey = w.s_nationkey and n.i = w.i""")
def span_match(t):
    spans = O.occurrence(t.supplier, ["s_nationkey"], ["s_suppkey"], "wanted").select("s_nationkey", F.col("wanted").cast("long").alias("wanted"), "s_suppkey")
    wanted = t.supplier.select("s_nationkey", (F.col("s_suppkey") % 4).alias("wanted")).distinct()
    return wanted.join(spans, ["s_nationkey", "wanted"], "left").select("s_nationkey", "wanted", "s_suppkey")


@query("""with s as (select p_partkey name, case when p_size > 40 then p_size / 10.0 else 0.0 end score from part), e as (select distinct l_suppkey caller, l_partkey callee from lineitem),
b as (select callee name, score * 0.30 v from e join s on s.name = caller where score > 0 union all select caller, score * 0.20 from e join s on s.name = callee where score > 0)
select s.name, round(score + coalesce((select sum(v) from b where b.name = s.name), 0.0), 2) score from s""")
def score_propagation(t):
    scores = t.part.select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") > 40, F.col("p_size") / 10.0).otherwise(0.0).alias("score"))
    out = R.score_propagation(scores, t.lineitem.select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee")))
    return out.withColumn("score", F.round("score", 2))


@query("""select 'union' op, count(*) n, sum(k)::bigint total from (select o_custkey k from orders where o_orderstatus = 'F' union select o_custkey from orders where o_orderstatus = 'O')
union all select 'intersect', count(*), sum(k) from (select o_custkey k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P')
union all select 'except', count(*), coalesce(sum(k), 0) from (select o_custkey k from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P')""")
def set_ops(t):
    of = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    total = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total"))
    return total(of("F").union(of("O")).distinct(), "union").unionByName(total(of("F").intersect(of("P")), "intersect")).unionByName(total(of("F").subtract(of("P")), "except"))


@query(f"""select page_id, case when not (path = 'a' or starts_with(path, 'a/') or path like '%p%') then 'outside submodules' when regexp_matches(lower(path), '(^|/)(tests?|specs?)/') then 'test file' end reason
from (select page_id, {PATH} path from pages)""")
def exclusion_reason(t):
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    p = t.pages.select("page_id", path.alias("path"))
    outside = ~(X.in_scope(F.col("path"), ["a"]) | F.col("path").contains("p"))
    return p.select("page_id", F.when(outside, "outside submodules").when(X.is_test_file(F.col("path")), "test file").alias("reason"))


@query("select p_partkey from part where p_size in (1, 2, 3) and contains(lower(p_name || ' ' || p_brand || ' ' || p_type || ' '), 'brand#1')")
def search_filter(t):
    return t.part.filter(F.col("p_size").isin(1, 2, 3) & X.search(" Brand#1 ", "p_name", "p_brand", "p_type")).select("p_partkey")


@query(rf"""with p as (select page_id, {PATH} path from pages), q as (select *, string_split(path, '/') s from p where path <> ''),
r as (select page_id, path, s[len(s)] base, array_to_string(s[1:len(s) - 1], '::') folder from q)
select page_id, case when folder <> '' then folder || '::' else '' end || regexp_replace(base, '^(.+)\.([^.]*)$', '\1-\2') || '::f' fqn, regexp_replace(regexp_replace(path, '\.[^./]*$', ''), '/', '--', 'g') bug_id from r""")
def path_fqn(t):
    p = t.pages.select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path")).filter("path <> ''")
    return p.select("page_id", X.fqn(F.col("path"), F.lit("f")).alias("fqn"), X.bug_id(F.col("path")).alias("bug_id"))


@query("""select c_custkey, 'src/' || lower(c_mktsegment) || '/m' || c_nationkey || '.py' source from customer""")
def fqn_inverse(t):
    path = F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/m"), F.col("c_nationkey").cast("string"), F.lit(".py"))
    return t.customer.select("c_custkey", X.fqn_source(X.fqn(path, F.lit("run"))).alias("source"))


@query("""select l_orderkey, l_partkey, l_suppkey, case when v is null then '—' when v >= 1000000 then printf('%.2fM', v::double / 1000000) when v >= 1000 then printf('%.1fK', v::double / 1000) else v::varchar end tokens,
case when q is null then '—' when q >= 3600 then printf('%dh %02dm %02ds', q // 3600, (q // 60) % 60, q % 60) when q >= 60 then printf('%dm %02ds', q // 60, q % 60) else printf('%ds', q) end as duration
from (select *, case when l_linenumber < 7 then (l_orderkey * l_linenumber)::bigint * 50 end v, case when l_quantity > 2 then (l_partkey * l_linenumber)::bigint end q from lineitem)""")
def format_labels(t):
    v = F.when(F.col("l_linenumber") < 7, F.col("l_orderkey") * F.col("l_linenumber") * 50)
    q = F.when(F.col("l_quantity") > 2, F.col("l_partkey") * F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", X.token_label(v).alias("tokens"), X.duration_label(q).alias("duration"))
