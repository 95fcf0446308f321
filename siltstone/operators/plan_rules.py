"""Rules on phase plans, as rows (phase, module, at, path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import artifacts as A
from siltstone.functions import expressions as X
from siltstone.operators.ordered import renumber


def one_owner(plan: DataFrame) -> DataFrame:
    """Each file with its earliest phase, then module and place."""
    first = plan.groupBy("path").agg(F.min(F.struct("phase", "at", "module")).alias("_o"))
    return first.select(F.col("_o.phase").alias("phase"), F.col("_o.module").alias("module"), F.col("_o.at").alias("at"), "path")


def phase_functions(plan: DataFrame, extracted: DataFrame) -> DataFrame:
    """(phase, module, at, path, file): the extracted files of each listed source, metadata files left out; a source listed in
    several phases has its files in each.  plan: (phase, module, at, path); extracted: (file)."""
    files = extracted.filter(~A.is_sidecar(F.col("file"))).select("file", A.source_of(F.col("file")).alias("path")).distinct()
    return plan.join(files, "path").select("phase", "module", "at", "path", "file")


def first_listed(functions: DataFrame) -> DataFrame:
    """The rows of ``phase_functions``, each file once: in the phase and at the place that come first."""
    first = functions.groupBy("file").agg(F.min(F.struct("phase", "at", "module", "path")).alias("_o"))
    return first.select(F.col("_o.phase").alias("phase"), F.col("_o.module").alias("module"), F.col("_o.at").alias("at"), F.col("_o.path").alias("path"), "file")


def listed_once(plan: DataFrame, extracted: DataFrame) -> DataFrame:
    """``first_listed`` of ``phase_functions``.  All files of a source have its place in the plan, so that the first one is found
    before the files come to it."""
    first = plan.groupBy("path").agg(F.min(F.struct("phase", "at", "module")).alias("_o"))
    return phase_functions(first.select("_o.phase", "_o.module", "_o.at", "path"), extracted)


def in_scope(plan: DataFrame, scopes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files within the scopes, and those that were removed."""
    keep = X.in_scope(F.col("path"), scopes)
    return plan.filter(keep), plan.filter(~keep).select("phase", "module", "path")


def compacted(phases: DataFrame, plan: DataFrame) -> DataFrame:
    """(phase, old, depends): phases that have files, numbered 1, 2, ... in their order; dependencies renumbered, those on
    removed phases dropped, sorted.  phases: (phase, depends_on_phases)."""
    live = phases.join(plan.select("phase").distinct(), "phase", "left_semi").select(F.col("phase").alias("old"), F.col("depends_on_phases").alias("_d"))
    numbered = renumber(live, "old", "phase").withColumn("phase", F.col("phase").cast("int"))
    deps = numbered.select("old", F.explode("_d").alias("_on")).join(numbered.select(F.col("old").alias("_on"), F.col("phase").alias("_new")), "_on")
    lists = deps.groupBy("old").agg(F.array_sort(F.collect_set("_new")).alias("depends"))
    return numbered.join(lists, "old", "left").select("phase", "old", F.coalesce("depends", F.array().cast("array<int>")).alias("depends"))


def _repr(text):
    """A text as Python shows it, for texts of printable characters."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _kind(value):
    """OBJECT, ARRAY, STRING and so on; null where there is no such value (a JSON null has the kind VOID)."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def violations(plans: DataFrame, key: str = "plan") -> DataFrame:
    """(key, at, message): a row for each place in which a plan breaks the shape phases[].modules[].source_files[]; plans:
    (key, json).  at: indices of phase, module and file, in whose order the messages are meant.  What is below a wrong place
    isn't looked at.  A null json counts as not valid."""
    rows = plans.select(key, F.try_parse_json("json").alias("v"))
    none = F.array().cast("array<int>")
    say = lambda df, at, message: df.select(key, at.alias("at"), message.alias("message"))
    fixed = lambda df, message: say(df, none, F.lit(message))
    # The messages' texts.
    out = [fixed(rows.filter("v is null"), "phases.json is not valid JSON")]
    known = rows.filter("v is not null").withColumn("kind", _kind(F.col("v"))).withColumn("phases", F.expr("try_variant_get(v, '$.phases', 'variant')"))
    out.append(fixed(known.filter("kind <> 'OBJECT'"), "the top-level value must be an object"))
    tops = known.filter("kind = 'OBJECT'").withColumn("is_list", F.coalesce(_kind(F.col("phases")) == "ARRAY", F.lit(False)))
    out.append(fixed(tops.filter("not is_list"), 'top-level field "phases" must be an array'))
    phases = tops.filter("is_list").selectExpr(key, "posexplode(try_variant_get(phases, '$', 'array<variant>')) as (i, p)").withColumn("kind", _kind(F.col("p"))).withColumn("at", F.array("i"))
    out.append(say(phases.filter("kind is null or kind <> 'OBJECT'"), F.col("at"), F.format_string("phases[%d] must be an object", "i")))
    named = phases.filter("kind = 'OBJECT'").withColumn("modules", F.expr("try_variant_get(p, '$.modules', 'variant')")).withColumn("is_list", F.coalesce(_kind(F.col("modules")) == "ARRAY", F.lit(False)))
    out.append(say(named.filter("not is_list"), F.col("at"), F.format_string("phases[%d].modules must be an array", "i")))
    modules = named.filter("is_list").selectExpr(key, "i", "posexplode(try_variant_get(modules, '$', 'array<variant>')) as (k, m)").withColumn("kind", _kind(F.col("m"))).withColumn("at", F.array("i", "k"))
    where = F.format_string("phases[%d].modules[%d]", "i", "k")
    out.append(say(modules.filter("kind is null or kind <> 'OBJECT'"), F.col("at"), F.concat(where, F.lit(" must be an object"))))
    name = F.expr("try_variant_get(m, '$.name', 'variant')")
    text = F.expr("try_variant_get(m, '$.name', 'string')")
    shown = F.when(_kind(name) == "STRING", _repr(text)).when(_kind(name) == "BOOLEAN", F.initcap(text)).otherwise(text)
    context = F.when(F.coalesce(text, F.lit("")).isin("", "0", "0.0", "false", "[]", "{}"), where).otherwise(F.concat(where, F.lit(" ("), shown, F.lit(")")))
    listed = modules.filter("kind = 'OBJECT'").withColumn("context", context).withColumn("files", F.expr("try_variant_get(m, '$.source_files', 'variant')")).withColumn("there", F.array_contains(F.json_object_keys(F.to_json("m")), "source_files"))
    listed = listed.withColumn("is_list", F.coalesce(_kind(F.col("files")) == "ARRAY", F.lit(False)))
    out.append(say(listed.filter("not there"), F.col("at"), F.concat("context", F.lit(".source_files is missing"))))
    out.append(say(listed.filter("there and not is_list"), F.col("at"), F.concat("context", F.lit(".source_files must be an array"))))
    files = listed.filter("is_list").selectExpr(key, "i", "k", "context", "posexplode(try_variant_get(files, '$', 'array<variant>')) as (n, f)").withColumn("at", F.array("i", "k", "n"))
    out.append(say(files.filter(~F.coalesce(_kind(F.col("f")) == "STRING", F.lit(False))), F.col("at"), F.concat("context", F.format_string(".source_files[%d] must be a string", "n"))))
    all_rows = out[0]
    for part in out[1:]:
        all_rows = all_rows.unionByName(part)
    return all_rows


def coverage_faults(plan: DataFrame, sources: DataFrame, scopes: list[str]) -> DataFrame:
    """(path, fault): listed but out of scope, listed but missing, or a source that isn't listed."""
    listed = plan.select("path").distinct()
    out = listed.filter(~X.in_scope(F.col("path"), scopes)).select("path", F.lit("out of scope").alias("fault"))
    gone = listed.join(sources, "path", "left_anti").select("path", F.lit("missing").alias("fault"))
    return out.unionByName(gone).unionByName(sources.join(listed, "path", "left_anti").select("path", F.lit("not listed").alias("fault")))


def changed_modules(*changes: DataFrame) -> DataFrame:
    """Distinct (phase, module) over change sets."""
    out = changes[0].select("phase", "module")
    for c in changes[1:]:
        out = out.unionByName(c.select("phase", "module"))
    return out.distinct()
