"""Queries over records beside functions: specifications, results, artifacts, links, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import artifacts as A
from siltstone.functions import expressions as X
from siltstone.operators import incremental as I
from siltstone.operators import ordered as O
from siltstone.operators import plan_rules as P
from siltstone.operators import relations as R
from siltstone.operators import reports as S
from siltstone.plans import stages
from siltstone.plans.registry import query
from siltstone.sources import records

#: A path for each document: languages that are known and not, tests, two scopes and others.
PATH = "source || case when doc_id % 11 = 0 then '/tests' else '' end || '/d' || doc_id || case doc_id % 4 when 0 then '.py' when 1 then '.rs' when 2 then '.txt' else '.Java' end"


def document_path():
    ext = F.element_at(F.array(*map(F.lit, (".py", ".rs", ".txt", ".Java"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return F.concat("source", F.when(F.col("doc_id") % 11 == 0, "/tests").otherwise(""), F.lit("/d"), F.col("doc_id").cast("string"), ext)


@query(f"""with f as (select {PATH} path, case when doc_id % 3 > 0 then n_chars % 7 end n from documents),
r as (select *, case when source not in ('src1', 'src2') then 'outside submodules' when path like '%/tests/%' then 'test file' end reason from (select *, split_part(path, '/', 1) source from f))
select reason, count(*) files, coalesce(sum(n), 0)::bigint functions, coalesce(string_agg(path, ',' order by path) filter (n is null and (path like '%.py' or path like '%.rs')), '') uncounted from r group by 1""")
def scope_counts(t):
    """Files and functions by why they are left out, and the files without known functions."""
    files = t.documents.select(document_path().alias("path"), "doc_id", "n_chars")
    functions = files.filter("doc_id % 3 > 0").select("path", (F.col("n_chars") % 7).alias("n"))
    out = I.counts(files.select("path"), functions, ["src1", "src2"])
    return out.select("reason", "files", "functions", F.array_join("uncounted", ",").alias("uncounted"))


@query("""select l_orderkey, count(*) gaps, string_agg(case when l_linenumber % 3 = 0 then '' else 's' || l_partkey end || '|' || 'p' || l_linenumber || '|' || l_returnflag, ',' order by l_linenumber, l_partkey, l_suppkey, l_returnflag) texts,
min(o_orderstatus) claim from lineitem join orders on o_orderkey = l_orderkey group by 1""")
def violation_gaps(t):
    """Gaps of an order's lines, each a violation with a statement that may be missing."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    statement = lambda x: F.when(x["l_linenumber"] % 3 != 0, F.concat(F.lit("s"), x["l_partkey"].cast("string")))
    lists = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(statement(x).alias("statements"), F.concat(F.lit("p"), x["l_linenumber"].cast("string")).alias("post_condition"), x["l_returnflag"].alias("reason"))).alias("v"))
    g = lists.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", A.gaps_of(F.col("v"), F.col("o_orderstatus")).alias("g"))
    text = F.transform("g", lambda x: F.concat_ws("|", x["code_evidence"], x["actual_behavior"], x["trigger_condition"]))
    return g.select("l_orderkey", F.size("g").cast("long").alias("gaps"), F.array_join(text, ",").alias("texts"), F.element_at("g", 1)["spec_claim"].alias("claim"))


@query("""select p_partkey, p_name as signature, case when p_size % 2 = 0 then p_type else '' end post, case p_size % 3 when 0 then null when 1 then 0 else 2 end::int callees,
case when p_size % 3 = 2 then 'a:' || p_brand || ',b:' end names from part""")
def sidecar_texts(t):
    """Supported fields of metadata with missing, foreign and wrong ones."""
    spec = F.to_json(F.struct(F.col("p_name").alias("signature"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("post_condition"), F.lit(1).alias("foreign")))
    callee = F.to_json(F.struct(F.array(F.struct(F.lit("a").alias("name"), F.col("p_brand").alias("signature")), F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("signature"))).alias("callees")))
    info = F.when(F.col("p_size") % 3 == 0, F.lit('{"callees": 3}')).when(F.col("p_size") % 3 == 1, F.lit('{"x": 1}')).otherwise(F.replace(callee, F.lit("]"), F.lit(", 7]")))
    d = t.part.select("p_partkey", A.supported_spec(spec).alias("s"), A.supported_info(info).alias("i"))
    return d.select("p_partkey", "s.signature", F.col("s.post_condition").alias("post"), F.when(F.col("i").isNotNull(), F.size("i")).alias("callees"), F.when(F.size("i") > 0, F.array_join(F.transform("i", lambda c: F.concat_ws(":", c["name"], c["signature"])), ",")).alias("names"))


@query("""with d as (select p_partkey, case when p_size > 5 then p_name end a, case when p_size % 3 = 0 then split_part(p_name, ' ', 1) when p_size % 3 = 1 then '  ' else ' ' || p_type || ' ' end b from part)
select p_partkey, case when trim(b) = '' or contains(coalesce(a, ''), trim(b)) then a when coalesce(a, '') = '' then trim(b) else a || chr(10) || chr(10) || trim(b) end description from d""")
def merged_descriptions(t):
    """Descriptions of merged modules: blank and contained ones add nothing."""
    b = F.when(F.col("p_size") % 3 == 0, F.split("p_name", " ")[0]).when(F.col("p_size") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), "p_type", F.lit(" ")))
    return t.part.select("p_partkey", A.merged_description(F.when(F.col("p_size") > 5, F.col("p_name")), b).alias("description"))


@query(f"""with f as (select {PATH} || case doc_id % 5 when 0 then '.spec.json' when 1 then '.info.json' when 2 then '.json' else '' end p, doc_id from documents)
select split_part(p, '/', 1) source, count(*) filter (not (ends_with(p, '.spec.json') or ends_with(p, '.info.json'))) functions, coalesce(string_agg(distinct p, ',' order by p) filter (ends_with(p, '.json') and not (ends_with(p, '.spec.json') or ends_with(p, '.info.json'))), '') other from f group by 1""")
def metadata_files(t):
    """Listed files without metadata, by source."""
    end = F.element_at(F.array(*map(F.lit, (".spec.json", ".info.json", ".json", "", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    files = records.file_list(t.documents.select(F.concat(document_path(), end).alias("path")))
    other = F.array_join(F.array_sort(F.collect_list(F.when(F.col("path").endswith(".json"), F.col("path")))), ",")
    sources = t.documents.select("source").distinct()
    counted = files.groupBy(F.split("path", "/")[0].alias("source")).agg(F.count("*").alias("functions"), other.alias("other"))
    return sources.join(counted, "source", "left").select("source", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("other", F.lit("")).alias("other"))


@query("""select 'all' as what, (select count(distinct n_nationkey) from nation where n_nationkey not in (select c_nationkey from customer)) = 0 and exists (select * from region where r_regionkey = 0) as complete
union all select 'rich', (select count(distinct n_nationkey) from nation where n_nationkey not in (select c_nationkey from customer where c_acctbal > 9990)) = 0
union all select 'prior', (select count(*) > 0 and bool_and(o_totalprice > 900) from orders where o_orderpriority like '1%')
union all select 'none', false""")
def run_completeness(t):
    """Whether every nation, as a phase, has a customer, as its types file; and whether an earlier run was whole."""
    phases = t.nation.select(F.col("n_nationkey").alias("phase"))
    types = lambda c: c.select(F.format_string("phase_%02d_types.txt", "c_nationkey").alias("name"))
    overview = t.region.filter("r_regionkey = 0").select(F.lit("engine_overview.txt").alias("name"))
    named = lambda df, what: df.select(F.lit(what).alias("what"), "complete")
    files = t.orders.select(F.concat(F.substring("o_orderpriority", 1, 1), F.lit("/f"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 9 == 0, ".spec.json").otherwise(".c")).alias("path"), (F.col("o_totalprice") > 900).alias("ready"))
    out = named(I.context_complete(phases, types(t.customer).unionByName(overview)), "all")
    out = out.unionByName(named(I.context_complete(phases, types(t.customer.filter("c_acctbal > 9990")).unionByName(overview)), "rich"))
    return out.unionByName(named(I.run_complete(files, "ready", ["1"]), "prior")).unionByName(named(I.run_complete(files, "ready", ["9"]), "none"))


@query("""select event_type, count(*) filter (k % 4 = 1) + count(*) filter (k % 4 = 3) errors, count(*) n from (select event_type, cast(json_extract_string(props, '$.k') as int) k from events) group by 1""")
def http_errors(t):
    """Events whose status is given and isn't 200, as a number or text."""
    k = F.get_json_object("props", "$.k").cast("int") % 4
    status = F.when(k == 0, "200").when(k == 1, "404").when(k == 2, "").otherwise("2000")
    return t.events.groupBy("event_type").agg(F.count_if(A.is_http_error(status)).alias("errors"), F.count("*").alias("n"))


@query("""select c_custkey as id, arg_min(o_orderpriority, o_orderkey) as symbol from customer left join orders on o_custkey = c_custkey and o_totalprice > 300000 group by 1""")
def prepared_symbols(t):
    candidates = t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("symbol"), "o_orderkey")
    return I.first_match(t.customer.select(F.col("c_custkey").alias("id")), candidates, "o_orderkey")


@query("""with n as (select n_regionkey r, lower('e' || n_nationkey % 3) e, n_name l, row_number() over (partition by n_regionkey order by n_nationkey) i, count(*) over (partition by n_regionkey) c from nation)
select r as region, e as extension, arg_max(l, i) as language from n where i < c group by 1, 2""")
def extension_languages(t):
    """Extensions and languages by their places; the longer list's rest is left out and the last of repeated extensions wins."""
    lists = t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    ext = F.transform("n", lambda x: F.concat(F.when(x["n_nationkey"] % 2 == 0, "..E").otherwise("e"), (x["n_nationkey"] % 3).cast("string")))
    pairs = A.zipped(ext, F.slice(F.transform("n", lambda x: x["n_name"]), 1, F.size("n") - 1))
    return lists.select("region", F.explode(pairs).alias("extension", "language"))


@query("""with a as (select o_orderkey k, o_orderkey % 5 r, 'v/' || o_custkey || '/f' || o_orderkey % 50 f from orders)
select case r when 0 then f || '.json' when 1 then f || '.bug-007.json' when 2 then 'w/' || replace(f, '/', '--') || '.result.json' when 3 then 'w/probe_' || replace(f, '/', '--') || '.bug-001.py' else 'w/other' || k || '.md' end as path from a
where r = 4 or f not in (select 'v/' || c_custkey || '/f' || i from customer, range(0, 50) t(i) where c_acctbal < 5000 and i % 2 = 0)""")
def cleared_artifacts(t):
    """Artifacts but those of functions that are done anew: verdicts, candidates, results and probes."""
    f = F.concat(F.lit("v/"), F.col("o_custkey").cast("string"), F.lit("/f"), (F.col("o_orderkey") % 50).cast("string"))
    flat, r = F.replace(f, F.lit("/"), F.lit("--")), F.col("o_orderkey") % 5
    path = F.when(r == 0, F.concat(f, F.lit(".json"))).when(r == 1, F.concat(f, F.lit(".bug-007.json"))).when(r == 2, F.concat(F.lit("w/"), flat, F.lit(".result.json"))).when(r == 3, F.concat(F.lit("w/probe_"), flat, F.lit(".bug-001.py"))).otherwise(F.concat(F.lit("w/other"), F.col("o_orderkey").cast("string"), F.lit(".md")))
    targets = t.customer.filter("c_acctbal < 5000").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(48), F.lit(2)), lambda i: F.concat(F.lit("v/"), F.col("c_custkey").cast("string"), F.lit("/f"), i.cast("string"), F.lit(".json")))).alias("file"))
    return records.cleared(t.orders.select(path.alias("path")), targets)


@query("""select o_orderstatus status, case o_orderkey % 6 when 0 then 'must be an object' when 1 then 'missing fields' when 2 then 'flags must be booleans' when 3 then 'updated_callees must be an array of texts' when 4 then case when o_orderstatus = 'F' then 'new_spec must be an object' end end error, count(*) n from orders group by 1, 2""")
def response_validation(t):
    """The first rule that a decision's JSON breaks, by kind of answer."""
    kind, done = F.col("o_orderkey") % 6, F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")
    text = F.when(kind == 0, "[1]").when(kind == 1, F.concat(F.lit('{"spec_updated": '), done, F.lit("}"))).otherwise(
        F.concat(F.lit('{"spec_updated": '), F.when(kind == 2, '"yes"').otherwise(done), F.lit(', "new_spec": '), F.when(kind == 4, "null").otherwise('{"signature": "s"}'), F.lit(', "info_updated": false, "new_info": null, "updated_callees": '), F.when(kind == 3, '["a", " "]').otherwise('["a"]'), F.lit("}"))
    )
    checked = stages.validated(t.orders.select("o_orderstatus", F.parse_json(text).alias("v")), stages.spec_update_rules("v"))
    return checked.groupBy(F.col("o_orderstatus").alias("status"), "error").agg(F.count("*").alias("n"))


@query("""with n as (select n_nationkey old, (row_number() over (order by n_nationkey))::int phase from nation where n_nationkey in (select s_nationkey from supplier where s_acctbal > 8000))
select printf('phase_%02d_types.txt', n_nationkey) as old, case when phase is not null then printf('phase_%02d_types.txt', phase) end as new from nation left join n on old = n_nationkey""")
def renamed_types(t):
    """Types files under the new numbers of the phases that stay."""
    live = t.supplier.filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("old")).distinct()
    return I.renamed(t.nation.select(F.col("n_nationkey").alias("old_phase")), O.renumber(live, "old", "phase"), "phase_%02d_types.txt")


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 'flat' || o_orderkey else (case when o_orderkey % 7 > 0 then 'new' else 'old' end) || '/extracted_functions/c' || o_custkey || '/f' || o_orderkey end as function from orders""")
def rebound_artifacts(t):
    """Stored paths of orders that exist in a newer workspace under the same identity."""
    tail = F.concat(F.lit("/extracted_functions/c"), F.col("o_custkey").cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string"))
    key = F.col("o_orderkey").cast("string")
    stored = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("flat"), key)).otherwise(F.concat(F.lit("old"), tail)).alias("function"))
    return I.rebind(stored, t.orders.filter("o_orderkey % 7 > 0").select(F.concat(F.lit("new"), tail).alias("function")))


@query("""with l as (select l_orderkey k, l_returnflag || l_linestatus as name, l_partkey p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) i from lineitem),
f as (select k, name, min(i) place, arg_max(p, i) p from l group by 1, 2)
select k as l_orderkey, string_agg(name || '=' || p, ',' order by place) specs from f group by 1""")
def spec_map(t):
    """Specifications by name: the last one of a name, at the place of the first."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("name"))
    text = lambda x: F.struct(x["name"].alias("name"), x["l_partkey"].cast("string").alias("signature"))
    lists = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), text).alias("c"))
    return lists.select("l_orderkey", F.array_join(F.transform(A.last_by_name(F.col("c")), lambda c: F.concat_ws("=", c["name"], c["signature"])), ",").alias("specs"))


@query("""with v as (select doc_id f, case when toxic = 1 then 'MISMATCH' else 'MATCH' end v, quality = 1 c from labels),
w as (select doc_id f from documents where doc_id not in (select f from v where c) or doc_id in (select f from v where c and v = 'MISMATCH' and f % 3 > 0))
select 'incomplete' as what, f::bigint f, null as target from w union all
select 'target', f, coalesce(target, f::varchar) from (select f from v where v = 'MISMATCH') left join (select doc_id f, doc_id || '.bug-00' || i as target from documents, range(1, 3) t(i) where doc_id % 2 = 0) using (f)""")
def open_work(t):
    """Files whose verdict or validation is missing, and what the validations of mismatches are aimed at."""
    file = F.col("doc_id").alias("file")
    verdicts = t.labels.select(file, F.when(F.col("toxic") == 1, "MISMATCH").otherwise("MATCH").alias("verdict"), (F.col("quality") == 1).alias("complete"))
    left = S.incomplete(t.documents.select(file), verdicts, t.documents.filter("doc_id % 3 = 0").select(file))
    candidates = t.documents.filter("doc_id % 2 = 0").select(file, F.explode(F.transform(F.array(F.lit(1), F.lit(2)), lambda i: F.format_string("%d.bug-%03d", F.col("doc_id"), i))).alias("target"))
    aims = S.validation_targets(verdicts.withColumn("file", F.col("file").cast("string")), candidates.withColumn("file", F.col("file").cast("string")))
    return left.select(F.lit("incomplete").alias("what"), F.col("file").alias("f"), F.lit(None).cast("string").alias("target")).unionByName(aims.select(F.lit("target").alias("what"), F.col("file").cast("long").alias("f"), "target"))


@query(f"""with i as (select doc_id, case doc_id % 5 when 0 then '/abs/' || doc_id when 1 then 'a/../' || doc_id when 2 then '' else {PATH} end p from documents)
select doc_id, case when p <> '' and not starts_with(p, '/') and p not like '%..%' then '../' || p end href from i""")
def report_links(t):
    """Links to source files; none for absolute paths, those that leave the tree and empty ones."""
    r, key = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    path = F.when(r == 0, F.concat(F.lit("/abs/"), key)).when(r == 1, F.concat(F.lit("a/../"), key)).when(r == 2, "").otherwise(document_path())
    return t.documents.select("doc_id", S.source_href(path).alias("href"))


@query("""with u as (select o_orderkey k, o_custkey c, 0 s, row_number() over (order by o_orderkey desc) p from orders where o_orderkey % 10 = 3 union all select o_orderkey, o_custkey, 1, row_number() over (order by o_totalprice, o_orderkey) from orders where o_orderstatus = 'P'),
f as (select c, min((s, p)) as place from u group by 1) select c as o_custkey, (row_number() over (order by place))::bigint as place from f""")
def ordered_union(t):
    """Changed and then untracked items, each once where it first stands."""
    changed = t.orders.filter("o_orderkey % 10 = 3").select("o_custkey", F.struct((-F.col("o_orderkey").cast("double")).alias("a"), F.col("o_orderkey").alias("b")).alias("at"))
    untracked = t.orders.filter("o_orderstatus = 'P'").select("o_custkey", F.struct(F.col("o_totalprice").alias("a"), F.col("o_orderkey").alias("b")).alias("at"))
    return R.ordered_union("o_custkey", "at", changed, untracked)


@query("""with n as (select l_suppkey s, l_partkey p, l_orderkey k, (row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber, l_quantity) - 1) // 7 b from lineitem)
select s as l_suppkey, b::int batch, (dense_rank() over (order by s, b) - 1)::bigint batch_index, count(*) n, min(k) first_order from n group by s, b""")
def indexed_batches(t):
    """Batches of seven lines a supplier, numbered through all suppliers."""
    out = O.indexed_batches(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"], 7)
    return out.groupBy("l_suppkey", "batch", "batch_index").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


_PLACES = ["a", "a.b", "a.b.n", "a.c.x", "a.c.y", "k", "z"]


@query(f"""select c_custkey, {", ".join(f"json_extract_string(m, '$.{p}') as " + p.replace(".", "_") for p in _PLACES[1:])}, json_type(m, '$.a') = 'OBJECT' as inner from (select c_custkey,
json_merge_patch('{{"a":{{"b":' || c_nationkey || ',"c":{{"x":[1,' || c_custkey || ']}}}},"k":"' || c_mktsegment || '"}}',
case c_custkey % 4 when 0 then '{{}}' when 1 then '{{"a":{{"c":{{"x":2,"y":{{"z":' || c_custkey || '}}}}}}}}' when 2 then '{{"a":{{"b":{{"n":"' || c_name || '"}}}},"z":true}}' else '{{"a":7}}' end) m from customer)""")
def merged_settings(t):
    """A customer's settings laid over those of its nation and segment."""
    from siltstone.operators.documents import deep_merged

    base = F.format_string('{"a": {"c": {"x": [1, %d]}, "b": %d}, "k": "%s"}', "c_custkey", "c_nationkey", "c_mktsegment")
    kind = F.col("c_custkey") % 4
    overlay = F.when(kind == 0, "{}").when(kind == 1, F.format_string('{"a": {"c": {"y": {"z": %d}, "x": 2}}}', "c_custkey")).when(kind == 2, F.format_string('{"z": true, "a": {"b": {"n": "%s"}}}', "c_name")).otherwise('{"a": 7}')
    merged = deep_merged(t.customer.select("c_custkey", base.alias("base"), overlay.alias("overlay")), "c_custkey", "base", "overlay")
    places = [F.get_json_object("json", f"$.{p}").alias(p.replace(".", "_")) for p in _PLACES[1:]]
    return merged.select("c_custkey", *places, F.get_json_object("json", "$.a").startswith("{").alias("inner"))


_ITEMS = """(select case when doc_id % 3 = 0 then 'analysis' else 'bug' end kind, doc_id::varchar id, case when doc_id % 3 = 0 then ['MATCH', 'ERROR', 'odd'][(doc_id % 3 + doc_id % 2 + 1)::int] else ['confirmed', 'pending', 'error'][(doc_id % 3)::int] end status,
source source_file, case when doc_id % 7 > 0 then 'L' || n_chars % 50 end loc, case when doc_id % 7 > 0 then n_chars % 50 end l from documents)"""
_RANK = "case status when 'MATCH' then 0 when 'ERROR' then 2 when 'confirmed' then 0 when 'error' then 2 when 'pending' then 3 else 99 end"


@query(f"""select 'status' as sorted_by, id, row_number() over (order by case status when 'confirmed' then 0 when 'error' then 2 when 'pending' then 3 when 'MATCH' then 10 when 'ERROR' then 12 else 99 end, kind, id) as place from {_ITEMS}
union all select 'file', id, row_number() over (order by source_file, kind, id) from {_ITEMS}
union all select 'location', id, row_number() over (order by l nulls last, case when l is null then kind end, case when l is null then {_RANK} end, kind, id) from {_ITEMS}""")
def sorted_report(t):
    """Places of report items under each order that a reader can choose."""
    n = F.col("doc_id")
    analysis = F.element_at(F.array(*map(F.lit, ("MATCH", "ERROR", "odd"))), (n % 3 + n % 2 + 1).cast("int"))
    bug = F.when(n % 3 > 0, F.element_at(F.array(*map(F.lit, ("confirmed", "pending", "error"))), F.greatest(F.lit(1), n % 3).cast("int")))
    items = t.documents.select(
        F.when(n % 3 == 0, "analysis").otherwise("bug").alias("kind"), n.cast("string").alias("id"), F.when(n % 3 == 0, analysis).otherwise(bug).alias("status"), F.col("source").alias("source_file"),
        F.lit("f").alias("function_name"), F.when(n % 7 > 0, F.concat(F.lit("f.c:L"), (F.col("n_chars") % 50).cast("string"), F.lit("-L99"))).alias("location"),
    )
    one = lambda by: S.sorted_items(items, by).select(F.lit(by).alias("sorted_by"), "id", F.col("place").cast("long").alias("place"))
    return one("status").unionByName(one("file")).unionByName(one("location"))


@query("""with b as (select doc_id::varchar id, case when toxic = 1 then 'confirmed' when quality = 1 then 'not_confirmed' when doc_id % 2 = 0 then 'error' end status from labels)
select count(*) n, count(*) filter (status = 'confirmed') confirmed, count(*) filter (status = 'error') errors, string_agg(id, ',' order by case status when 'confirmed' then 0 when 'not_confirmed' then 1 when 'error' then 2 else 3 end, id) ids from b""")
def summary_documents(t):
    """The summary's document, read back: totals and bugs in its order."""
    status = F.when(F.col("toxic") == 1, "confirmed").when(F.col("quality") == 1, "not_confirmed").when(F.col("doc_id") % 2 == 0, "error")
    doc = S.summary_document(t.labels.select(F.col("doc_id").cast("string").alias("id"), status.alias("status")))
    parsed = doc.select(F.from_json("json", "total_reported long, total_confirmed long, total_error long, bugs array<struct<id: string>>").alias("d"))
    return parsed.select(F.col("d.total_reported").alias("n"), F.col("d.total_confirmed").alias("confirmed"), F.col("d.total_error").alias("errors"), F.array_join("d.bugs.id", ",").alias("ids"))


@query("select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 5 as marked from part")
def marked_ranks(t):
    """A file's functions by score, the first five marked."""
    return O.marked_top(t.part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5).select("p_partkey", F.col("rank").cast("long").alias("rank"), "marked")


@query("""with p as (select c_custkey % 3 phase, c_mktsegment module, c_custkey "at", 'src/m' || c_nationkey || '.x.c' path from customer where c_nationkey < 20),
x as (select distinct 'src/m' || o_custkey % 25 || '.x.c' path, 'src/m' || o_custkey % 25 || '.x-c/f' || o_orderkey % 40 || '.c' file from orders where o_orderkey % 3 > 0),
f as (select p.*, file from p join x using (path))
select 'each' as what, phase, module, count(*) n, min(file) file from f group by 2, 3
union all select 'once', phase, module, count(*), min(file) from (select file, arg_min(phase, (phase, "at")) phase, arg_min(module, (phase, "at")) module from f group by 1) group by 2, 3""")
def phase_files(t):
    """Extracted files of the phases' sources, in every phase that lists them and once in the first."""
    key = lambda c: c.cast("string")
    plan = t.customer.filter("c_nationkey < 20").select((F.col("c_custkey") % 3).alias("phase"), F.col("c_mktsegment").alias("module"), F.col("c_custkey").alias("at"), F.concat(F.lit("src/m"), key(F.col("c_nationkey")), F.lit(".x.c")).alias("path"))
    file = F.concat(F.lit("src/m"), key(F.col("o_custkey") % 25), F.lit(".x-c/f"), key(F.col("o_orderkey") % 40), F.when(F.col("o_orderkey") % 3 == 0, ".c.spec.json").otherwise(".c"))
    each = P.phase_functions(plan, t.orders.select(file.alias("file")))
    # By file first: counts are kept by hash, while a least text would have all rows sorted.
    files = lambda df: df.groupBy("phase", "module", "file").agg(F.count("*").alias("n"))
    count = lambda df, what: files(df).groupBy("phase", "module").agg(F.sum("n").alias("n"), F.min("file").alias("file")).select(F.lit(what).alias("what"), "phase", "module", "n", "file")
    return count(each, "each").unionByName(count(P.listed_once(plan, t.orders.select(file.alias("file"))), "once"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 4 = 0 and l_suppkey > l_linenumber then l_suppkey - 1 else l_suppkey end end_line,
case when l_linenumber % 3 = 0 then 'own' when l_linenumber % 3 = 1 then 'other' end callers from lineitem""")
def phase_lookup(t):
    """Last lines of nodes, and the callers of a phase or else of any."""
    n = F.col("l_linenumber")
    columns = F.when(n % 3 == 0, F.create_map(F.lit("x"), F.lit("no"), F.lit("phase9_callers"), F.lit("other"), F.concat(F.lit("phase"), n.cast("string"), F.lit("_callers")), F.lit("own"))).when(n % 3 == 1, F.create_map(F.lit("phase_note"), F.lit("no"), F.lit("phase99_callers"), F.lit("other"))).otherwise(F.create_map(F.lit("callers"), F.lit("no")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.node_end_line(n.cast("long"), F.col("l_suppkey"), F.col("l_partkey") % 4).alias("end_line"), X.phase_value(columns, n).alias("callers"))
