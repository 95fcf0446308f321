"""Joins and set operations with the artifact rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Pairs of one name that one row's arrays form at most, more or less: its sides have the square root of it.
DEALT = 1 << 28
#: Callers that stand in a row for one callee, so that the pairs take few bytes where they are written, and callees that meet them at once.
RUN = 256
SOME = 64


def _equal_names(sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """(caller, callee) of equal names, each pair once.  sites: (caller, name); definitions: (callee, name).

    A callee with one name meets a caller once, so only pairs of callees with several names are made distinct afterwards.
    A name's callers and callees are arrays of ``side`` ids; each array of one side meets each of the other, and pairs are
    formed behind the last shuffle only: it moves 2 * side ids for side * side pairs."""
    side = math.isqrt(DEALT)
    definitions = definitions.select("callee", "name").filter("name is not null and callee is not null").repartition("callee").distinct()
    sites = sites.select("caller", "name").filter("caller is not null").join(definitions.select("name").distinct(), "name", "left_semi").select("caller", "name").distinct()
    named = definitions.groupBy("name").agg(F.ceil(F.count("*") / side).alias("_q"))
    sizes = sites.groupBy("name").agg(F.ceil(F.count("*") / side).alias("_p")).join(named.hint("merge"), "name")
    alone = definitions.groupBy("callee").agg((F.min("name") == F.max("name")).alias("_alone"))
    part = lambda x, n: F.pmod(F.xxhash64(x), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ours = sites.join(sizes.hint("merge"), "name").groupBy("name", "_q", part("caller", "_p").alias("_i")).agg(F.collect_list("caller").alias("_callers")).withColumn("_j", each("_q"))
    theirs = definitions.join(alone.hint("merge"), "callee").join(sizes.hint("merge"), "name").groupBy("name", "_p", "_alone", part("callee", "_q").alias("_j")).agg(F.collect_list("callee").alias("_callees")).withColumn("_i", each("_p"))
    # Small sides may form many pairs: as many tasks as the session shuffles with, however small these sides are.
    parts = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "name", "_i", "_j")
    cut = lambda x, n: F.expr(f"transform(sequence(0, (size({x}) - 1) div {n}), i -> slice({x}, int(i * {n} + 1), {n}))")

    def meet(of: str) -> DataFrame:
        met = dealt(ours.drop("_q")).join(dealt(theirs.filter(of).drop("_p", "_alone")).hint("merge"), ["name", "_i", "_j"])
        # An explode's compiled loop holds all rows of one input row, so the last two get short arrays.
        met = met.select(cut("_callers", RUN).alias("_rows"), cut("_callees", SOME).alias("_somes"))
        met = met.select(F.explode(F.expr("flatten(transform(_rows, r -> transform(_somes, s -> struct(r, s))))")).alias("_both")).select(F.col("_both.r").alias("_row"), F.col("_both.s").alias("_some"))
        return met.select("_row", F.explode("_some").alias("callee")).select(F.explode("_row").alias("caller"), "callee").filter("caller <> callee")

    return meet("_alone").unionByName(meet("not _alone").distinct())


def resolve_call_sites(sites: DataFrame, definitions: DataFrame, keywords: list[str]) -> DataFrame:
    """(caller, callee): every definition with the site's name but the caller itself and keywords.
    sites: (caller, name); definitions: (callee, name)."""
    return _equal_names(sites.filter(~F.col("name").isin(keywords)), definitions)


def within(edges: DataFrame, src: str, dst: str, known: DataFrame, key: str) -> DataFrame:
    """Edges whose two ends are known."""
    a, b = known.select(F.col(key).alias(src)).distinct(), known.select(F.col(key).alias(dst)).distinct()
    return edges.join(a, src, "left_semi").join(b, dst, "left_semi")


def supplemental_edges(exact: DataFrame, by_name: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """(caller, callee) of exact edges and of edges given by a call site's name, where the callee is known.
    exact: (caller, callee); by_name: (name, callee); names: (caller, name); known: (callee)."""
    theirs = by_name.select("name", "callee").join(known.select("callee").distinct().hint("merge"), "callee", "left_semi")
    ours = exact.select("caller", "callee").join(known.select("callee").distinct().hint("merge"), "callee", "left_semi").filter("caller <> callee").distinct()
    # What a name gives as well is left to it, so that the two parts share no edge.
    both = ours.join(theirs.hint("merge"), "callee").join(names.select("caller", "name").distinct().hint("merge"), ["caller", "name"], "left_semi").select("caller", "callee").distinct()
    return ours.join(both.hint("merge"), ["caller", "callee"], "left_anti").unionByName(_equal_names(names, theirs))


def pending_rows(candidates: DataFrame, validations: DataFrame, key: str, status: str, valid: Column) -> DataFrame:
    """Every candidate with its status: a validation without a valid record is 'pending' with reason 'invalid_result', none
    at all 'missing_or_invalid_result'; validations without a candidate are ignored."""
    v = validations.select(key, status, valid.alias("_valid"))
    return candidates.join(v, key, "left").select(
        *candidates.columns, F.when(F.coalesce("_valid", F.lit(False)), F.col(status)).otherwise("pending").alias(status),
        F.when(F.col("_valid").isNull(), "missing_or_invalid_result").when(~F.col("_valid"), "invalid_result").alias("reason"),
    )


def stale(existing: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """What exists but isn't current."""
    return existing.join(current, key, "left_anti")


def price_lookup(rows: DataFrame, model: str, prices: DataFrame, key: str, price: str) -> DataFrame:
    """The price of the exact model, else of what follows its first '/'; null without either.  The price list is a dimension
    and left to the planner's own size check."""
    p = prices.groupBy(F.col(key).alias("_k")).agg(F.min(price).alias("_p"))
    tail = F.when(F.col(model).contains("/"), F.expr(f"substring({model}, instr({model}, '/') + 1)"))
    return (
        rows.join(p.withColumnRenamed("_p", "_exact"), F.col(model) == F.col("_k"), "left").drop("_k")
        .join(p.withColumnRenamed("_p", "_tail"), tail == F.col("_k"), "left").drop("_k")
        .withColumn(price, F.coalesce("_exact", "_tail")).drop("_exact", "_tail")
    )


def request_response(requests: DataFrame, responses: DataFrame, key: list[str], order: str, fill: list[str]) -> DataFrame:
    """Each response with its last earlier request of the same key; ``fill`` columns come from the request where the
    response has none.  Responses without one stay.  One pass over both sides by key, no pair of rows is formed."""
    from pyspark.sql import Window

    cols = [*key, order, *fill]
    both = requests.select(*cols, F.lit(0).alias("_r")).unionByName(responses.select(*cols, F.lit(1).alias("_r")))
    w = Window.partitionBy(*key).orderBy(order, F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col("_r") == 0, F.struct(F.col(c).alias("v"))), ignorenulls=True).over(w)["v"]
    return both.withColumn("request_order", last(order)).select(*key, order, "_r", "request_order", *(F.coalesce(c, last(c)).alias(c) for c in fill)).filter("_r = 1").drop("_r")


def revision_diff(old: DataFrame, new: DataFrame, key: list[str], value: Column) -> DataFrame:
    """key and change ('added', 'removed', 'modified') of rows that differ between two snapshots."""
    o, n = old.select(*key, F.struct(value).alias("_o")), new.select(*key, F.struct(value).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return o.join(n, key, "full_outer").select(*key, change.alias("change")).filter("change is not null")


def relevant(rows: DataFrame, key: str, chosen: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose key is chosen or owns something changed."""
    return rows.join(chosen.select(key).unionByName(changed.select(key)).distinct(), key, "left_semi")


def dual_key(names: DataFrame, name: str, items: DataFrame, item: str, keys: Column) -> DataFrame:
    """(name, item): by any of an item's keys; names without a hit are tried again without a trailing _<number>."""
    keyed = items.select(item, F.explode(F.array_distinct(keys)).alias("_k")).distinct()
    names = names.select(name).distinct()
    first = names.join(keyed, F.col(name) == F.col("_k")).select(name, item)
    rest = names.join(keyed.select(F.col("_k").alias(name)).distinct().hint("merge"), name, "left_anti")
    second = rest.join(keyed, F.regexp_replace(name, r"_\d+$", "") == F.col("_k")).select(name, item)
    # A name is in one of the two parts and meets an item there by one key, so no pair comes twice.
    return first.unionByName(second)


def score_propagation(scores: DataFrame, calls: DataFrame) -> DataFrame:
    """score + 0.30 of each scored caller's and 0.20 of each scored callee's score, rounded to 3 places.
    scores: (name, score); calls: (caller, callee).  Two equi-joins and a sum."""
    lit = scores.filter("score > 0")
    edges = calls.select("caller", "callee").distinct()
    down = edges.join(lit, edges.caller == lit.name).select(F.col("callee").alias("name"), (F.col("score") * 0.30).alias("bonus"))
    up = edges.join(lit, edges.callee == lit.name).select(F.col("caller").alias("name"), (F.col("score") * 0.20).alias("bonus"))
    bonus = down.unionByName(up).groupBy("name").agg(F.sum("bonus").alias("bonus"))
    return scores.join(bonus, "name", "left").select("name", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 3).alias("score"))


def set_flags(df: DataFrame, group: list[str], item: str, expected: Column) -> DataFrame:
    """For each group whether its items are exactly, and at least, the expected array."""
    have = df.groupBy(*group).agg(F.array_sort(F.collect_set(item)).alias("_have"), F.first(expected).alias("_want"))
    want = F.array_sort(F.array_distinct("_want"))
    return have.select(*group, (F.col("_have") == want).alias("equal"), (F.size(F.array_except(want, "_have")) == 0).alias("covers"))


def bare_name(ident: Column) -> Column:
    """What follows the last :: or dot of an identifier, without a trailing _<number>."""
    return F.regexp_replace(F.element_at(F.split(ident, r"::|\."), -1), r"_\d+$", "")


def ordered_coverage(ours: DataFrame, theirs: DataFrame, file: str = "path") -> DataFrame:
    """(file, covered): whether the functions of ``theirs`` are a subsequence of those of ``ours`` in each file; both are
    (file, at, ident, body), and two functions are the same with equal bare names and bodies (line ends don't count).

    Every function of theirs gets the places of its equals in ours by a join; then a fold in order takes the next place
    beyond the last one taken, which finds a subsequence if there is one.  Files of ours alone are covered; a null body is
    one of its own.
    """
    body = F.coalesce(F.sha2(F.regexp_replace("body", "\r\n|\r", "\n"), 256), F.lit("null"))
    keyed = lambda df: df.select(file, "at", bare_name(F.col("ident")).alias("_n"), body.alias("_b"))
    places = keyed(ours).groupBy(file, "_n", "_b").agg(F.array_sort(F.collect_list("at")).alias("places"))
    wanted = keyed(theirs).join(places, [file, "_n", "_b"], "left").groupBy(file).agg(F.array_sort(F.collect_list(F.struct("at", "places"))).alias("w"))
    taken = lambda last, w: F.array_min(F.filter(w["places"], lambda p: p > last))
    start = F.array_min(F.flatten("w.places")) - 1
    end = F.aggregate("w", F.coalesce(start, F.lit(0)).cast("long"), lambda last, w: taken(last, w).cast("long"))
    files = ours.select(file).unionByName(theirs.select(file)).distinct()
    return files.join(wanted.select(file, end.isNotNull().alias("covered")), file, "left").select(file, F.coalesce("covered", F.lit(True)).alias("covered"))


def ordered_union(key: str, at: str, *frames: DataFrame) -> DataFrame:
    """(key, place): every key of the frames once, numbered from 1 where it first stands: frames one after the other, each in
    the order of ``at``, whose type they share.  Null is a key like any other.

    A frame's keys are brought to one row each before they meet, and places come from ranges that are sorted side by side.
    """
    from siltstone.operators.ordered import renumber

    firsts = None
    for i, df in enumerate(frames):
        own = df.groupBy(key).agg(F.struct(F.lit(i).alias("frame"), F.min(at).alias("at")).alias("_at"))
        firsts = own if firsts is None else firsts.unionByName(own)
    first = firsts.groupBy(key).agg(F.min("_at").alias("_at"))
    return renumber(first, "_at", "place").select(key, F.col("place").cast("long").alias("place"))
