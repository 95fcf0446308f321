"""Queries of later runs: change sets, propagation, readiness, order, texts of specifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import artifacts as A
from siltstone.operators import incremental as I
from siltstone.operators import relations as R
from siltstone.plans.registry import query

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""select doc_id, md5({TRIM.format("text")}) pre, md5({TRIM.format("source || chr(10) || lang")}) post from documents where text is not null""")
def spec_round_trip(t):
    """Conditions read back from the text of a specification made of a document."""
    spec = A.spec_text(F.col("lang"), F.col("text"), F.concat_ws("\n", "source", "lang"))
    c = t.documents.filter("text is not null").select("doc_id", A.conditions(spec).alias("c"))
    return c.select("doc_id", F.md5(F.encode("c.pre", "UTF-8")).alias("pre"), F.md5(F.encode("c.post", "UTF-8")).alias("post"))


VERDICT = "case event_type when 'view' then 'MATCH' when 'error' then 'ERROR' else 'MISMATCH' end"


@query(f"""select event_id, {VERDICT} verdict, case when {VERDICT} = 'MISMATCH' then 's' || user_id end evidence, case when {VERDICT} = 'MISMATCH' then event_type end post, case when {VERDICT} = 'MISMATCH' then 'r' || event_id end as trigger from events""")
def gap_extraction(t):
    """Gaps read from the verdict texts of events."""
    mismatch = F.format_string("x\nStatements triggering the violation:\n s%d \n\nPost-condition:\n%s\n\nReason for violation:\n r%d\n", "user_id", "event_type", "event_id")
    result = F.when(F.col("event_type") == "view", "It passes the verification.").when(F.col("event_type") == "error", "Failed to run").otherwise(mismatch)
    g = t.events.select("event_id", A.gaps(result, F.lit("c")).alias("g"))
    return g.select("event_id", "g.verdict", F.col("g.gaps.code_evidence").alias("evidence"), F.col("g.gaps.actual_behavior").alias("post"), F.col("g.gaps.trigger_condition").alias("trigger"))


@query("""select source, array_to_string(list_sort(list(distinct lang)), ',') all_idents, coalesce(array_to_string(list_sort(list(distinct lang) filter (doc_id in (select doc_id from labels))), ','), '') kept_idents from documents group by 1""")
def functions_by_source(t):
    d = t.documents.select("doc_id", "source", F.col("lang").alias("ident"))
    out = I.by_source(d, d.join(t.labels.select("doc_id"), "doc_id", "left_semi"))
    return out.select("source", F.array_join("all_idents", ",").alias("all_idents"), F.array_join("kept_idents", ",").alias("kept_idents"))


@query("select distinct l_suppkey k from lineitem where l_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'R' and l_quantity > 49)")
def unreachable_ends(t):
    ends = t.lineitem.select(F.col("l_suppkey").alias("k"))
    return I.unreachable(ends, t.lineitem.filter("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("k")), "k")


@query("""select lang as "language" from documents where source = 'src1' union (select lang from documents where source = 'src2' intersect select lang from documents where source = 'src3')""")
def blocked_languages(t):
    of = lambda s: t.documents.filter(F.col("source") == s).select(F.col("lang").alias("language"))
    return I.blocked_languages(of("src1"), of("src2"), of("src3"))


@query("""select o_custkey::varchar path, o_orderpriority ident, arg_max(o_totalprice, o_orderkey) body from orders group by 1, 2""")
def bodies_by_path(t):
    return I.bodies_by_path(t.orders.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderpriority").alias("ident"), F.col("o_totalprice").alias("body"), "o_orderkey"), "o_orderkey")


@query("""with c as (select o_orderkey k, case when o_orderkey % 10 = 0 then 'added' when o_orderkey % 10 = 1 then 'removed' when o_orderkey % 7 = 0 then 'modified' end change from orders)
select 'src/' || k path from c where change in ('added', 'modified') and k % 10 <> 1 or k in (select l_orderkey from lineitem where l_quantity > 49) and k % 10 <> 1""")
def verify_again(t):
    """Orders of two revisions that were added or changed, and those with an updated line, as far as they still exist."""
    path = F.concat(F.lit("src/"), F.col("k").cast("string")).alias("path")
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.filter("k % 10 <> 1").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    changed = R.revision_diff(o.filter("k % 10 <> 0"), new, ["k"], F.col("v")).select(path, "change")
    updated = t.lineitem.filter("l_quantity > 49").select(F.col("l_orderkey").alias("k")).select(path)
    return I.to_verify(changed, updated, new.select(path), ["src"])


@query("""select distinct doc_id::varchar path from documents where doc_id not in (select doc_id from labels where toxic = 0 and doc_id is not null and doc_id % 7 <> 0)""")
def resume_targets(t):
    """Documents without a valid label, and every seventh anew."""
    path = F.col("doc_id").cast("string").alias("path")
    return I.to_resume(t.documents.select(path), t.labels.select(path, "toxic"), F.col("toxic") == 0, t.documents.filter("doc_id % 7 = 0").select(path))


EDGES = "(select distinct l_suppkey::varchar caller, l_partkey::varchar callee, l_shipmode as name from (select *, 'n' || l_linenumber l_shipmode from lineitem))"


def edges(t):
    return t.lineitem.select(F.col("l_suppkey").cast("string").alias("caller"), F.col("l_partkey").cast("string").alias("callee"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name")).distinct()


@query(f"""select distinct callee fqn from {EDGES} where caller::bigint % 3 = 0 and name = 'n1' and callee::bigint % 5 <> 0""")
def queued_callees(t):
    applied = t.supplier.select(F.col("s_suppkey").cast("string").alias("fqn"), (F.col("s_suppkey") % 3 == 0).alias("info_updated"), F.array(F.lit("n1")).alias("updated_callees"))
    return I.queued_callees(applied, edges(t), t.part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("fqn")))


@query(f"""select caller, string_agg(callee || '=' || p_name, ',' order by callee, p_name) updates from (select distinct caller, callee from {EDGES}) join part on callee = p_partkey::varchar where p_size = 7 group by 1""")
def caller_updates(t):
    applied = t.part.filter("p_size = 7").select(F.col("p_partkey").cast("string").alias("fqn"), F.col("p_name").alias("spec"))
    out = I.caller_updates(applied, edges(t))
    return out.select("caller", F.array_join(F.transform("updates", lambda u: F.concat_ws("=", u["name"], u["spec"])), ",").alias("updates"))


@query("""with b as (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderstatus, o_orderkey) r from orders where o_totalprice > 400000)
select c_custkey::varchar as name, o_orderpriority phase, o_orderstatus layer from customer left join b on c_custkey = o_custkey and r = 1""")
def topdown_order(t):
    """Customers in the order of their first large order, others by name."""
    places = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderpriority").alias("phase"), F.col("o_orderstatus").alias("layer"), F.col("o_orderkey").alias("position"))
    return I.topdown(t.customer.select(F.col("c_custkey").cast("string").alias("name")), places)


@query("""select event_id, case when k <= k2 and k2 < 80 then k end as first, case when k <= k2 and k2 < 80 then k2 end as last from (select event_id, cast(json_extract_string(props, '$.k') as int) k, (event_id % 100)::int k2 from events)""")
def layer_ranges(t):
    text = F.concat(F.get_json_object("props", "$.k"), F.lit("-"), (F.col("event_id") % 100).cast("string"))
    return t.events.select("event_id", A.layer_range(text, F.lit(80)).alias("r")).select("event_id", "r.first", "r.last")
