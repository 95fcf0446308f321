"""Queries over texts: lines, blocks, tokens, mentions, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.words import STOP
from siltstone.operators import ordered as O
from siltstone.operators import relations as R
from siltstone.operators import relevance as V
from siltstone.plans.registry import query
from siltstone.session import written

#: Documents a task has at most, about, where each meets many items.
DEALT = 5_000


@query("""select doc_id, case when n > 0 then name || '_' || n else name end as name from (select doc_id, source || '::' || lang as name, row_number() over (partition by source, lang order by doc_id) - 1 n from documents)""")
def occurrence_suffix(t):
    d = O.occurrence(t.documents.select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], "n")
    return d.select("doc_id", O.with_suffix(F.concat_ws("::", "source", "lang"), F.col("n")).alias("name"))


@query("""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') ls from documents)
select doc_id, unnest(range(1, len(ls) + 1))::int line_no, md5(unnest(ls)) line from l""")
def line_numbers(t):
    return O.numbered_lines(t.documents.select("doc_id", "text"), "text").select("doc_id", "line_no", F.md5(F.encode("line", "UTF-8")).alias("line"))


@query("""with n as (select doc_id, len(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) n from documents),
b as (select doc_id, n, case when n <= 80 then 1 else 1 + (n - 80 + 39) // 40 end::int b from n)
select doc_id, n words, b blocks, (n - (b - 1) * 40)::int last_block from b""")
def block_split(t):
    n = F.size(F.filter(F.split("text", "[ \n]+"), lambda x: x != ""))
    sizes = t.documents.select("doc_id", n.alias("words")).withColumn("s", O.block_sizes(F.col("words"), 40))
    return sizes.select("doc_id", "words", F.size("s").alias("blocks"), F.element_at("s", -1).alias("last_block"))


@query("""with v as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as name from benchmark), d as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as name from documents)
select doc_id caller, count(*) callees from d join v using (name) where name not in ('the', 'of', 'and', 'in') group by 1""")
def callsite_resolution(t):
    """Documents call the items' words."""
    words = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("name"))
    names = words(t.benchmark).distinct().select("name", F.col("name").alias("callee"))
    found = R.resolve_call_sites(words(t.documents, F.col("doc_id").cast("string").alias("caller")), names, ["the", "of", "and", "in"])
    return found.groupBy(F.col("caller").cast("long").alias("caller")).agg(F.count("*").alias("callees"))


@query("""with d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) w from documents), b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) w from benchmark),
x as (select doc_id, unnest(w) t from d), y as (select item_id, unnest(w) t from b where len(w) > 0), n as (select item_id, doc_id, count(*) shared from x join y using (t) group by 1, 2)
select item_id, doc_id, shared from (select *, row_number() over (partition by item_id order by shared desc, doc_id) r from n) where r <= 5""")
def overlap_score(t):
    """The five documents that share the most words with each item.  Documents are dealt out by id, a bounded number to a task,
    so that pairs of an item and a document are counted where the document is, and only the first five leave the task."""
    words = lambda df, key: df.select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    groups = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.documents.count() // DEALT))
    documents = words(t.documents, "doc_id").repartition(groups, "doc_id")
    items = written(words(t.benchmark, "item_id").select("item_id", F.explode("w").alias("w")), "items")
    shared = documents.select("doc_id", F.explode("w").alias("w")).join(items, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return O.top_k(shared, ["item_id"], [F.desc("shared"), F.col("doc_id")], 5).select("item_id", "doc_id", "shared")


PATTERNS = {"en": r"(?i)\b(the|of)\.$", "fr": r"(?i)(tion|ment)\.$", "default": r"[.!?]$"}


@query("""with l as (select doc_id, lang, unnest(string_split(text, chr(10))) line from documents)
select doc_id, count(*) n from l where case lang when 'en' then regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])(the|of)\\.$') when 'fr' then regexp_matches(line, '(?i)(tion|ment)\\.$') else regexp_matches(line, '[.!?]$') end group by 1""")
def terminating_rows(t):
    """Lines that end with their language's terminating pattern; the pattern is a column."""
    spark = t.spark
    dimension = F.broadcast(spark.createDataFrame(list(PATTERNS.items()), "lang string, pattern string"))  # a fixed list
    lines = t.documents.select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line"))
    default = F.lit(PATTERNS["default"])
    return lines.join(dimension, "lang", "left").filter(F.rlike("line", F.coalesce("pattern", default))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""with p as (select item_id, lower(text || ' fails in run_' || item_id || chr(10) || 'as `Foo.bar_baz` raises a ValueError') low from benchmark),
w as (select item_id, len(list_filter(list_distinct(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')), lambda x: regexp_full_match(x, '[a-z]{{4,}}') and x not in ({", ".join(f"'{w}'" for w in STOP)}))) n from p)
select item_id, tier, tokens::bigint tokens from (select item_id, 'traceback' tier, 1 tokens from p union all select item_id, 'quoted', 2 from p union all select item_id, 'dotted', 3 from p
union all select item_id, 'dotted_class', 1 from p union all select item_id, 'plain', 8 + (item_id > 99)::int from p union all select item_id, 'exception', 1 from p union all select item_id, 'prose', n from w)""")
def intent_signals(t):
    """Distinct names and words by tier of each item with a sentence of names after it."""
    text = F.concat("text", F.lit(" fails in run_"), F.col("item_id").cast("string"), F.lit("\nas `Foo.bar_baz` raises a ValueError"))
    tiers = [F.struct(F.lit(k).alias("tier"), F.size(c).cast("long").alias("tokens")) for k, c in V.tier_columns(text).items()]
    return t.benchmark.select("item_id", F.inline(F.array(*tiers))).filter("tokens > 0")


INTENT = "It stops in make_red_gear\n`small_ring` and Widget.make_blue_bolt give a ValueError; HotGear, valve and plate turn slowly."


@query(r"""with f as (select p_partkey, 'make_' || replace(p_name, ' ', '_') n, string_split(p_name, ' ') k, p_size from part),
p as (select p_partkey, p_size, list_distinct([n, 'make'] || k || ['make_' || k[1]] || list_transform(range(1, len(k)), lambda i: k[i] || '_' || k[i + 1])) a, k from f)
select p_partkey, round(10 * len(list_intersect(a, ['make_red_gear'])) + 5 * len(list_intersect(a, ['small_ring'])) + 2 * len(list_intersect(k, ['small_ring']))
+ 15 * len(list_intersect(a, ['make_blue_bolt', 'make', 'blue', 'bolt'])) + 3 * len(list_intersect(a, ['make_red_gear', 'make', 'red', 'gear', 'small_ring', 'small', 'ring', 'make_blue_bolt', 'blue', 'bolt', 'valueerror', 'value', 'error', 'hotgear', 'hot']))
+ 1.5 * len(list_intersect(list_filter(a, lambda x: len(x) >= 5), ['stops', 'give', 'valueerror', 'hotgear', 'valve', 'plate', 'turn', 'slowly', 'widget']))
+ len(list_intersect(k, ['stops', 'give', 'valueerror', 'hotgear', 'valve', 'plate', 'turn', 'slowly', 'widget'])) / sqrt(greatest(p_size, 1)), 6) score from p""")
def relevance_base(t):
    """Parts as functions named after them, scored against an intent, without the typo-tolerant part."""
    parts = t.part.select("p_partkey", V.name_parts(F.concat(F.lit("make_"), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("a"), F.split("p_name", " ").alias("k"), "p_size")
    score = V.exact_score(F.col("a"), F.col("k"), F.col("k"), F.lit(None).cast("array<string>"), F.col("p_size"), V.signals(INTENT))
    return parts.select("p_partkey", F.round(score, 6).alias("score"))


@query()
def relevance_rank(t):
    """The three most relevant functions of each brand's file, with the typo-tolerant part and the shares of callers; that
    part is beyond SQL."""
    name = F.concat(F.lit("make_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    none = F.array().cast("array<string>")
    functions = t.part.select(
        F.col("p_brand").alias("path"), name.alias("name"), F.col("p_partkey").cast("int").alias("first"), (F.col("p_partkey") + F.col("p_size")).cast("int").alias("last"),
        F.array(F.concat(F.lit("make_"), F.replace(F.reverse(F.split("p_name", " "))[0], F.lit(" "), F.lit("_")))).alias("calls"), F.split("p_name", " ").alias("idents"), F.split("p_name", " ").alias("words"), none.alias("exceptions"),
    )
    classes = functions.groupBy("path").agg(F.lit("Widget").alias("name"), F.lit("A valve or plate.").alias("docstring"), F.array(F.min("first")).alias("method_lines"))
    return V.ranked(functions, classes, INTENT, 3)


@query()
def fuzzy_names(t):
    """Words of the items that match closely; gestalt matching is beyond SQL."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name")).distinct()
    return T.similar_names(words, words, "name").filter("a < b")


@query()
def extract_functions(t):
    """Functions of sources written from the parts' names, one file a brand and language."""
    body = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    python = F.concat(F.lit("def "), body, F.lit("(x):\n    return "), F.col("p_size").cast("string"), F.lit("\n"))
    c = F.concat(F.lit("int "), body, F.lit("(int x) {\n  return "), F.col("p_size").cast("string"), F.lit("; // }\n}\n"))
    parts = t.part.select("p_brand", "p_size", "p_partkey", F.explode(F.array(F.struct(F.lit("py").alias("ext"), F.lit("python").alias("lang"), python.alias("code")), F.struct(F.lit("c").alias("ext"), F.lit("c").alias("lang"), c.alias("code")))).alias("s"))
    files = parts.groupBy(F.concat_ws("/", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("s.ext"))).alias("path"), F.col("s.lang").alias("lang")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.col("s.code").alias("code")))), lambda x: x["code"]), "\n").alias("content")
    )
    return T.functions_of(files)


@query("select conv_id, count(*) turns, string_agg(role, '>' order by turn, role) roles from conversations group by 1")
def conversation_turns(t):
    """Children of a trace in order, as one label."""
    c = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("c"))
    return c.select("conv_id", "turns", F.array_join("c.role", ">").alias("roles"))


@query("select label, count(*) n, round(avg(list_sum(embedding)), 2) mean from embeddings group by 1")
def vector_summary(t):
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(total), 2).alias("mean"))
