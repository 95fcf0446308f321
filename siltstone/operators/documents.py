"""JSON documents as rows of paths and leaves: nested objects laid over each other and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import written

_PARTS = "map<string,variant>"


def leaves(documents: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value, empty): a row for each value of a document that isn't an object with members; path: the names that
    lead to it, value: its JSON, empty: whether it is an object without members.  Null and malformed documents have no rows.
    A round opens the objects of one depth, for all documents at once."""
    now = documents.select(key, F.array().cast("array<string>").alias("path"), F.try_parse_json(json).alias("v")).filter("v is not null")
    parts = F.expr(f"try_variant_get(v, '$', '{_PARTS}')")
    is_object = F.schema_of_variant(F.col("v")).startswith("OBJECT")
    out = None
    while True:
        opened = now.withColumn("is_object", is_object).withColumn("parts", F.when(F.col("is_object"), parts))
        level = opened.select(key, "path", F.to_json("v").alias("value"), (F.col("is_object") & (F.size("parts") == 0)).alias("empty"), (F.col("is_object") & (F.size("parts") > 0)).alias("inner"))
        level = written(level, "documents")
        found = level.filter("not inner").drop("inner")
        out = found if out is None else out.unionByName(found)
        inner = level.filter("inner")
        if inner.isEmpty():
            return out
        children = inner.select(key, "path", F.explode(F.expr(f"try_variant_get(parse_json(value), '$', '{_PARTS}')")).alias("name", "v"))
        now = children.select(key, F.array_append("path", F.col("name")).alias("path"), "v")


def assembled(parts: DataFrame, key: str) -> DataFrame:
    """(key, json): documents from (key, path, value), members in the order of their names.  A round closes the objects of one
    depth, the deepest first."""
    left = written(parts.select(key, "path", "value"), "parts")
    deepest = left.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    for depth in range(deepest, 0, -1):
        low = left.filter(F.size("path") == depth)
        member = F.struct(F.element_at("path", -1).alias("name"), "value")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda m: F.concat(F.to_json(F.array(m["name"])).substr(F.lit(2), F.length(F.to_json(F.array(m["name"]))) - 2), F.lit(":"), m["value"])), ",")
        closed = low.groupBy(key, F.slice("path", 1, F.lit(depth - 1)).alias("path")).agg(F.concat(F.lit("{"), text, F.lit("}")).alias("value"))
        left = written(left.filter(F.size("path") < depth).unionByName(closed), "parts")
    return left.select(key, F.col("value").alias("json"))


def _above(paths: DataFrame, key: str, itself: bool) -> DataFrame:
    """(key, path) of all places above these, and of these themselves if asked for."""
    top = F.size("path") if itself else F.size("path") - 1
    depths = F.when(top >= 0, F.sequence(F.lit(0), top)).otherwise(F.array().cast("array<int>"))
    return paths.select(key, F.explode(F.transform(depths, lambda n: F.slice("path", F.lit(1), n))).alias("path")).distinct()


def deep_merged(documents: DataFrame, key: str, base: str, overlay: str) -> DataFrame:
    """(key, json): the overlay laid over the base.  Objects that both have are merged member by member, at any depth; of
    anything else (arrays too) the overlay's counts.  An empty object changes nothing where the base has an object.  A null
    in the overlay is a value.  Where one document is null or malformed the other counts; without both there is no row.

    key is unique.  Leaves of the base go where the overlay has a leaf at their place or above it, or an object at their
    place: two joins by document and path."""
    under, over = leaves(documents, key, base), leaves(documents, key, overlay)
    inner = _above(under, key, False)
    over = over.join(inner.withColumn("_i", F.lit(True)), [key, "path"], "left").filter("not (empty and coalesce(_i, false))").drop("_i")
    over = written(over, "overlay")
    covered = under.withColumn("_p", F.col("path")).select(key, "_p", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("path"))
    gone = covered.join(over.select(key, "path"), [key, "path"], "left_semi").select(key, F.col("_p").alias("path")).distinct()
    kept = under.join(gone, [key, "path"], "left_anti").join(_above(over, key, False), [key, "path"], "left_anti")
    return assembled(kept.unionByName(over), key)
