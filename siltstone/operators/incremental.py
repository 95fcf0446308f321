"""What a later run has to do again: change sets, propagation of specifications, counts, readiness, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import artifacts as A
from siltstone.functions import expressions as X


def by_source(functions: DataFrame, kept: DataFrame) -> DataFrame:
    """(source, all_idents, kept_idents): sorted distinct identifiers of each source file, of all functions and of the kept
    ones.  functions: (source, ident); kept: (source, ident)."""
    both = functions.select("source", "ident", F.lit(False).alias("_k")).unionByName(kept.select("source", "ident", F.lit(True).alias("_k")))
    kinds = lambda flag: F.array_sort(F.collect_set(F.when(F.col("_k") == flag, F.col("ident"))))
    return both.groupBy("source").agg(kinds(False).alias("all_idents"), kinds(True).alias("kept_idents"))


def counts(files: DataFrame, functions: DataFrame, scopes: list[str]) -> DataFrame:
    """(reason, files, functions, uncounted): files and their functions by why they are left out (null: included), and the
    sorted files with a language of which no functions are known.  files: (path); functions: (path, n) of counted files."""
    f = files.join(functions, "path", "left").withColumn("reason", X.exclusion_reason(F.col("path"), scopes))
    known = X.language(F.col("path")) != "unknown"
    return f.groupBy("reason").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("functions"),
        F.array_sort(F.collect_list(F.when(known & F.col("n").isNull(), F.col("path")))).alias("uncounted"),
    )


def unreachable(ends: DataFrame, reached: DataFrame, key: str) -> DataFrame:
    """Distinct ends that weren't reached, null ones included."""
    return ends.select(key).distinct().join(reached.select(key).distinct(), key, "left_anti")


def blocked_languages(unavailable: DataFrame, declared: DataFrame, failed: DataFrame) -> DataFrame:
    """(language): unavailable ones, and declared ones whose extraction failed."""
    return unavailable.select("language").union(declared.select("language").intersect(failed.select("language"))).distinct()


def bodies_by_path(index: DataFrame, order: str) -> DataFrame:
    """(path, ident, body): one row an identifier of a path, the body that comes last.  index: (path, ident, body, order)."""
    return index.groupBy("path", "ident").agg(F.max(F.struct(order, "body")).alias("_l")).select("path", "ident", F.col("_l.body").alias("body"))


def rebind(stored: DataFrame, current: DataFrame) -> DataFrame:
    """stored with ``function`` set to the current path of the same function; without one it stays.
    stored: (function, ...); current: (function), one path an identity (else the smallest)."""
    now = current.select(A.identity(F.col("function")).alias("_i"), F.col("function").alias("_f")).filter("_i is not null").groupBy("_i").agg(F.min("_f").alias("_f"))
    joined = stored.withColumn("_i", A.identity(F.col("function"))).join(now, "_i", "left")
    return joined.withColumn("function", F.coalesce("_f", "function")).select(stored.columns)


def queued_callees(applied: DataFrame, edges: DataFrame, checked: DataFrame) -> DataFrame:
    """(fqn): callees whose expectation an applied plan changed and that weren't checked yet.
    applied: (fqn, info_updated, updated_callees); edges: (caller, callee, name), ``name`` any name the caller uses for it."""
    named = applied.filter("info_updated").select(F.col("fqn").alias("caller"), F.explode("updated_callees").alias("name")).distinct()
    return named.join(edges, ["caller", "name"]).select(F.col("callee").alias("fqn")).distinct().join(checked, "fqn", "left_anti")


def caller_updates(applied: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller, updates): for each caller of a function with a new specification the sorted array of struct(name, spec).
    applied: (fqn, spec); edges: (caller, callee).  A caller's list is as long as its callees that changed in this round."""
    name = F.element_at(F.split("fqn", "::"), -1)
    new = applied.select(F.col("fqn").alias("callee"), F.struct(name.alias("name"), "spec").alias("_u"))
    return edges.select("caller", "callee").distinct().join(new, "callee").groupBy("caller").agg(F.array_sort(F.collect_list("_u")).alias("updates"))


def to_verify(changed: DataFrame, updated: DataFrame, existing: DataFrame, scopes: list[str]) -> DataFrame:
    """(path): added or modified functions and those whose specification was updated, as far as they exist and lie within the
    scopes.  changed: (path, change); updated, existing: (path)."""
    some = changed.filter(F.col("change").isin("added", "modified")).select("path").unionByName(updated.select("path")).distinct()
    return some.join(existing.select("path"), "path", "left_semi").filter(X.in_scope(F.col("path"), scopes))


def to_resume(targets: DataFrame, results: DataFrame, valid: Column, anew: DataFrame | None = None) -> DataFrame:
    """(path): targets without a valid result; a result counts as the checkpoint of its function unless it is corrupt or its
    path is to be done anew.  results: (path, ...) with the columns of ``valid``."""
    done = results.filter(F.coalesce(valid, F.lit(False))).select("path").distinct()
    if anew is not None:
        done = done.join(anew.select("path"), "path", "left_anti")
    return targets.select("path").distinct().join(done, "path", "left_anti")


def run_complete(files: DataFrame, ready: str, scopes: list[str]) -> DataFrame:
    """One row (complete): whether some function lies within the scopes and all of these are ready; metadata files don't
    count.  files: (path, ready)."""
    f = files.filter(~A.is_sidecar(F.col("path")) & X.in_scope(F.col("path"), scopes))
    return f.agg((F.coalesce(F.bool_and(F.coalesce(F.col(ready), F.lit(False))), F.lit(False)) & (F.count("*") > 0)).alias("complete"))


def context_complete(phases: DataFrame, files: DataFrame) -> DataFrame:
    """One row (complete): whether the overview and a types file of every phase are there, and every phase has a number.
    phases: (phase); files: (name)."""
    want = phases.select(F.when(F.col("phase").isNotNull(), F.format_string("phase_%02d_types.txt", F.col("phase").cast("int"))).alias("name"))
    want = want.unionByName(phases.sparkSession.range(1).select(F.lit("engine_overview.txt").alias("name")))
    return want.join(files.select("name").distinct(), "name", "left_anti").agg((F.count("*") == 0).alias("complete"))


def topdown(functions: DataFrame, places: DataFrame) -> DataFrame:
    """functions in the order phase, layer, position, name; those without a place last, by name.
    functions: (name); places: (name, phase, layer, position), of which the first counts."""
    first = places.groupBy("name").agg(F.min(F.struct("phase", "layer", "position")).alias("_o"))
    return functions.join(first, "name", "left").orderBy(F.asc_nulls_last("_o"), "name").select("name", F.col("_o.phase").alias("phase"), F.col("_o.layer").alias("layer"))


def renamed(files: DataFrame, numbers: DataFrame, name: str) -> DataFrame:
    """(old, new): types files under their phase's new number; null for phases that are gone.  Both sides are rows, so numbers
    never collide.  files: (old_phase); numbers: (old, phase)."""
    label = lambda c: F.format_string(name, c.cast("int"))
    n = numbers.select(F.col("old").alias("old_phase"), F.col("phase").alias("_n"))
    return files.join(n, "old_phase", "left").select(label(F.col("old_phase")).alias("old"), F.when(F.col("_n").isNotNull(), label(F.col("_n"))).alias("new"))


def first_match(wanted: DataFrame, candidates: DataFrame, order: str) -> DataFrame:
    """wanted with the candidate of equal id that comes first.  wanted: (id); candidates: (id, symbol, order)."""
    first = candidates.groupBy("id").agg(F.min_by("symbol", order).alias("symbol"))
    return wanted.join(first, "id", "left")
