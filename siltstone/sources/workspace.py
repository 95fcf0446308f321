"""Analysis workspaces: plans, sidecars, verdicts, validations, edges, histories; and their writers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import expressions as X

PHASES = "phases array<struct<phase:int,name:string,description:string,depends_on_phases:array<int>,modules:array<struct<name:string,description:string,source_files:array<string>>>>>"
GAPS = "struct<spec_claim:string,actual_behavior:string,code_evidence:string,trigger_condition:string>"
VERDICT = f"function string, verdict string, gaps {GAPS}, error string, all_bugs boolean, bug_count int, reasoning_complete boolean"
HISTORY = "schema_version int, run_id string, recorded_at string, included_file_count long, function_count long, duration_seconds double, llm_calls long, tokens long, cost_usd double, model string"
EDGES = "edges array<struct<caller:struct<function:string,identifier:string,callsite_names:array<string>>,callee:struct<function:string,info_names:array<string>>,source:string>>"


def plan_files(spark: SparkSession, path: str) -> DataFrame:
    """(phase, phase_name, module, at, path): files of a plan in its order; a malformed plan has none."""
    plan = spark.read.schema(PHASES).option("multiLine", True).json(path)
    p = plan.select(F.explode("phases").alias("p")).select("p.phase", F.col("p.name").alias("phase_name"), F.posexplode("p.modules").alias("_i", "m"))
    return p.select("phase", "phase_name", F.col("m.name").alias("module"), "_i", F.posexplode("m.source_files").alias("_j", "path")).select("phase", "phase_name", "module", F.struct("_i", "_j").alias("at"), "path")


def json_tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(file, json): each document below root whose name matches, whole; unreadable JSON is null in ``json``."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("json"))


def results(spark: SparkSession, root: str, candidates: bool = False) -> DataFrame:
    """Verdicts below root: (file, ...); with ``candidates`` the numbered records of several bugs, else without them."""
    numbered = F.col("file").rlike(r"\.bug-\d{3}\.json$")
    return json_tree(spark, root, "*.json").filter(numbered if candidates else ~numbered).filter("json is not null").select("file", F.from_json("json", VERDICT).alias("v")).select("file", "v.*")


def validations(spark: SparkSession, root: str) -> DataFrame:
    """(file, id, status, record): finished and unfinished validation records; unreadable ones are left out."""
    r = json_tree(spark, root, "*.result.json").filter("json is not null").select("file", F.parse_json("json").alias("record"))
    text = lambda n: F.expr(f"try_variant_get(record, '$.{n}', 'string')")
    return r.select("file", text("id").alias("id"), text("confirmation_status").alias("status"), "record")


def call_edges(spark: SparkSession, path: str) -> DataFrame:
    """Supplemental edges of a file or of every JSON below a folder: (caller, callee, names, source, at), merged by
    (caller, callee).  A record without caller or callee is an error."""
    docs = json_tree(spark, path, "*.json").withColumn("_e", F.from_json("json", EDGES))
    e = docs.select("file", F.posexplode("_e.edges").alias("at", "e")).select(
        F.col("e.caller.function").alias("c"), F.col("e.callee.function").alias("callee"), F.coalesce("e.callee.info_names", F.array().cast("array<string>")).alias("names"),
        F.coalesce("e.source", F.lit("")).alias("source"), F.struct("file", "at").alias("at"),
    )
    label = F.regexp_replace(F.trim(F.col("c")), "[;'\"]+$", "")
    file_label = label.rlike(r"^[^:]*\.[A-Za-z0-9]+::")
    caller = F.when(file_label, X.fqn(F.regexp_extract(label, "^([^:]*)::", 1), F.regexp_extract(label, "^[^:]*::(.*)$", 1))).otherwise(label)
    checked = F.when(F.col("c").isNull() | F.col("callee").isNull(), F.raise_error(F.lit("an edge needs caller.function and callee.function"))).otherwise(caller)
    return e.select(checked.alias("caller"), "callee", "names", "source", "at")


def merged_call_edges(edges: DataFrame) -> DataFrame:
    """One row for each (caller, callee): the first source, names in order without repeats; sorted."""
    g = edges.groupBy("caller", "callee").agg(F.array_sort(F.collect_list(F.struct("at", "names"))).alias("_n"), F.min(F.struct("at", "source")).alias("_s"))
    return g.select("caller", "callee", F.array_distinct(F.flatten("_n.names")).alias("names"), F.col("_s.source").alias("source")).orderBy("caller", "callee")


def history(spark: SparkSession, *paths: str) -> DataFrame:
    """Run records of one or more JSONL files in order, the last of each run_id, at the place of the first."""
    from siltstone.operators.aggregates import last_wins

    frames = [_numbered_lines(spark, p).withColumn("_f", F.lit(i)) for i, p in enumerate(paths)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    parsed = rows.select("_f", "_i", F.from_json("line", HISTORY).alias("r")).filter("r is not null").select("_f", "_i", "r.*")
    return last_wins(parsed, ["run_id"], ["_f", "_i"], [c for c in parsed.columns if c not in ("_f", "_i", "run_id")])


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(_i, line): lines that aren't blank; _i orders them, files of a folder by their names."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return raw.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line")).select(F.struct("file", "n").alias("_i"), "line").filter("trim(line) <> ''")


def last_version(spark: SparkSession, path: str) -> str | None:
    """The last line of a log that isn't blank."""
    row = _numbered_lines(spark, path).agg(F.max_by("line", "_i")).first()
    return row[0].strip() if row and row[0] else None


def knowledge(spark: SparkSession, paths: list[str]) -> str:
    """Markdown files joined in order, each once."""
    if bad := [p for p in paths if not p.lower().endswith((".md", ".markdown"))]:
        raise ValueError(f"not Markdown: {bad[0]}")
    order = {p: i for i, p in enumerate(dict.fromkeys(os.path.normpath(p) for p in paths))}
    return "\n\n".join(spark.read.text(p, wholetext=True).first()[0].strip() for p in order)


def sidecar_ready(functions: DataFrame, specs: DataFrame, infos: DataFrame) -> DataFrame:
    """Functions (file) that have a valid spec and a valid info: specs and infos are (file, json)."""
    good = specs.filter(X.valid_spec(F.col("json"))).select("file")
    info = F.from_json("json", "callees array<struct<name:string,signature:string,pre_condition:string,post_condition:string>>")
    variant = F.try_parse_json("json")
    each = F.expr("try_variant_get(try_parse_json(json), '$.callees', 'array<map<string,variant>>')")
    exact = F.forall(each, lambda m: (F.array_sort(F.map_keys(m)) == F.array(*map(F.lit, sorted(["name", "signature", "pre_condition", "post_condition"])))) & F.forall(F.map_values(m), lambda v: F.schema_of_variant(v) == "STRING"))
    fine = infos.filter(X.has_exactly_keys(F.col("json"), ["callees"]) & info.isNotNull() & variant.isNotNull() & F.coalesce(exact, F.lit(False))).select("file")
    return functions.join(good, "file", "left_semi").join(fine, "file", "left_semi")


# ---- writers -------------------------------------------------------------------------------------------------------


def write_json(path: str, value) -> None:
    """One small document on the driver's file system, replaced at once."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)


def append_lines(df: DataFrame, path: str) -> None:
    """Append records as JSON lines; Spark's committer makes each write whole or absent."""
    df.write.mode("append").json(path)


def overwrite_by_key(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def layer_documents(layers: DataFrame) -> DataFrame:
    """(phase, json): each phase's layers in order, members sorted; layers: (phase, layer, cycle_resolution, name)."""
    rows = layers.groupBy("phase", "layer", "cycle_resolution").agg(F.array_sort(F.collect_list("name")).alias("functions"))
    out = rows.groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("layer", "cycle_resolution", "functions"))).alias("layers"))
    return out.select("phase", F.to_json(F.struct("phase", "layers")).alias("json"))


def fingerprint(df: DataFrame, *columns: str) -> str:
    """SHA-256 over the sorted rows' JSON: hashes of rows are sorted and hashed again, so only digests are gathered."""
    digest = df.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("d")).groupBy(F.substring("d", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return digest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), ""), 256)).first()[0]


def write_report(items: DataFrame, path: str, title: str = "Report") -> None:
    """A self-contained page with the items in report order; the same items give the same bytes.  For reports, which people
    read whole."""
    from siltstone.operators.reports import in_order

    rows = [r.asDict(True) for r in in_order(items).collect()]
    data = json.dumps(rows, ensure_ascii=False, sort_keys=True).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    page = f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><pre id=out></pre><script>const items={data};document.getElementById('out').textContent=JSON.stringify(items,null,1)</script>\n"
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(page)
    os.replace(f"{path}.tmp", path)
