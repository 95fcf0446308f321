"""Benchmark decontamination: size-partitioned MinHash containment search, natively.

A document contains an item if it has at least ``percent`` of the item's distinct word shingles.  Items are partitioned by
size (powers of two).  In a class of at most u shingles up to m = u * (100 - percent) / 100 of them may be absent, so
the item's sketch is its 2 * m + 1 least shingle hashes: a document that contains the item has at least size(sketch) -
n * (100 - percent) / 100 of them, whatever its own length.  Documents are not sketched: all their shingles meet the
sketches, which find the candidates without a miss; candidates are then verified on the item's whole set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import broadcast_if_small, docs_of, table, written
from siltstone.llm.wordarrays import rolling, with_words


def item_sketches(benchmark: DataFrame, width: int, percent: int) -> DataFrame:
    """Distinct (item_id, text): item (a key), item_id, n (distinct shingles), most (that may be absent), all, sketch."""
    items = benchmark.filter("item_id is not null").select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    words = with_words(items).select("item_id", F.xxhash64("item_id", "text").alias("item"), "w")
    sets = words.select("item", "item_id", F.array_sort(F.array_distinct(rolling("w", width))).alias("all")).withColumn("n", F.size("all")).filter("n > 0")
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    return sets.withColumn("most", F.expr(f"n * {100 - percent} div 100")).withColumn(
        "sketch", F.slice("all", 1, F.least(F.col("n"), (2 * F.floor(top * (100 - percent) / 100) + 1).cast("int")))
    )


def contained_items(documents: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Return (doc_id, item_id, n_shingles, n_found) for every item that a document contains.

    Words are runs of ASCII letters and digits and of anything outside ASCII, lower-cased.  An item with fewer than
    ``width`` words has no shingle and is never found; null and empty texts contain nothing.  Rows that repeat a doc_id
    count as one document, rows that repeat an item_id with another text as items of their own (a pair is returned once,
    for the text found most).  Rows without an id are left out.
    """
    docs = docs_of(documents).filter("doc_id is not null")
    items = written(item_sketches(benchmark, width, percent), "items")
    per_item = items.select("item", "n", "most", F.size("sketch").alias("k"), F.explode("sketch").alias("g"))
    sketches = written(per_item, "sketches")

    def grams(df: DataFrame) -> DataFrame:
        return with_words(df).select("doc_id", rolling("w", width).alias("s")).select("doc_id", F.explode(F.array_distinct("s")).alias("g"))

    hits = grams(docs).join(broadcast_if_small(sketches, 48), "g")
    found = hits.groupBy("doc_id", "item").agg(F.count_distinct("g").alias("c"), F.first("k").alias("k"), F.first("most").alias("most")).filter("c >= greatest(1, k - most)")
    candidates = written(found.select("doc_id", "item"), "candidates")
    ids = written(candidates.select("doc_id").distinct(), "candidate-ids")
    wanted = items.join(candidates.select("item").distinct(), "item", "left_semi").select("item", F.explode("all").alias("g"))
    wanted = written(wanted, "wanted")
    again = grams(docs.join(broadcast_if_small(ids, 16), "doc_id", "left_semi")).join(broadcast_if_small(wanted, 24), "g")
    counted = again.groupBy("doc_id", "item").agg(F.count_distinct("g").alias("n_found")).join(candidates, ["doc_id", "item"])
    named = items.select("item", "item_id", "n")
    return (
        counted.join(broadcast_if_small(named, 32), "item")
        .filter(f"100 * n_found >= {percent} * n")
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_found", "n")).alias("x"))
        .select("doc_id", "item_id", F.col("x.n").cast("long").alias("n_shingles"), F.col("x.n_found").alias("n_found"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: items of ``benchmark`` in whole ``documents``, five words, 0.8."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with d as (select distinct doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents where doc_id is not null),
b as (select distinct item_id, coalesce(text, '') t, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where item_id is not null),
dg as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) g from d),
bg as (select distinct item_id, t, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) g from b),
n as (select item_id, t, count(*) n from bg group by 1, 2),
h as (select doc_id, item_id, t, count(*) c from dg join bg using (g) group by 1, 2, 3)
select doc_id, item_id, arg_max(n, c * 1000000 + n) n_shingles, max(c) n_found
from h join n using (item_id, t) where 100 * c >= 80 * n group by 1, 2
"""
