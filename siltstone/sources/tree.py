"""Source trees as tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.functions import text as T

#: Directories that a scan leaves out, besides hidden ones.
PRUNED = ["node_modules", "__pycache__", "venv", ".venv"]
#: What the wider scan of entry runs leaves out.
PRUNED_ENTRY = [".git"]


def _walk(root: str, pruned: list[str], hidden: bool):
    """(path below root, None) of files and (path, reason) of directories that are not entered.  The driver lists: Spark's own
    listing skips names that begin with '_' or '.', __init__.py among them."""
    for top, dirs, names in os.walk(root):
        at = os.path.relpath(top, root).replace(os.sep, "/")
        below = lambda name: name if at == "." else f"{at}/{name}"  # noqa: B023, E731
        for d in sorted(dirs):
            if d in pruned or (hidden and d.startswith(".")):
                yield below(d), d
        dirs[:] = sorted(d for d in dirs if d not in pruned and not (hidden and d.startswith(".")))
        for n in sorted(names):
            yield below(n), None


def files(spark: SparkSession, root: str, pruned: list[str] = PRUNED, hidden: bool = True) -> DataFrame:
    """(path) of every file below root outside pruned directories."""
    return spark.createDataFrame([(p,) for p, reason in _walk(root, pruned, hidden) if reason is None], "path string")


def source_files(spark: SparkSession, root: str, submodules: list[str] | None = None, entry: bool = False, workspace: tuple[str, ...] = ()) -> DataFrame:
    """path, ext, lang, included and reason of every file with a known extension outside pruned directories and outside
    directories named as an analysis ``workspace``."""
    f = files(spark, root, [*(PRUNED_ENTRY if entry else PRUNED), *workspace], not entry).withColumn("ext", X.extension(F.col("path")))
    p = F.col("path")
    kept = f.filter(F.col("ext").isin(list(X.LANGUAGES)))
    reason = F.when(X.is_test_file(p), "test file") if entry else X.exclusion_reason(p, submodules or [])
    return kept.select("path", "ext", X.language(p).alias("lang"), reason.isNull().alias("included"), reason.alias("reason"))


def pruned_directories(spark: SparkSession, root: str) -> DataFrame:
    """(path, reason) of pruned directories, by depth, path and reason."""
    rows = [(p, reason) for p, reason in _walk(root, PRUNED, True) if reason]
    return spark.createDataFrame(rows, "path string, reason string").distinct().orderBy(F.size(F.split("path", "/")), "path", "reason")


def has_sources(spark: SparkSession, root: str) -> bool:
    """Whether there is any included source; stops at the first."""
    return not source_files(spark, root).filter("included").isEmpty()


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, lang, content) of the wanted files; bytes that are no UTF-8 become replacement characters."""
    names = {r["path"]: r["lang"] for r in wanted.select("path", "lang").collect()}  # a listing, made on the driver
    if not names:
        return spark.createDataFrame([], "path string, lang string, content string")
    base = os.path.abspath(root)
    raw = spark.read.format("binaryFile").load([f"{base}/{p}" for p in names])
    text = F.col("content").cast("string")
    read = raw.select(F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})").alias("path"), text.alias("_t"))
    fixed = F.make_valid_utf8("_t")
    return read.join(wanted.select("path", "lang"), "path").select("path", "lang", fixed.alias("content"))


def extract(spark: SparkSession, root: str, submodules: list[str] | None = None, backend: DataFrame | None = None, ready: DataFrame | None = None) -> DataFrame:
    """Functions of all included files: fqn, path, lang, ident, start_idx, end_idx, body.  Files that ``backend`` has
    (the same columns) are taken from there; files in ``ready`` (path) are left alone."""
    wanted = source_files(spark, root, submodules).filter("included").select("path", "lang")
    if ready is not None:
        wanted = wanted.join(ready.select("path"), "path", "left_anti")
    cols = ["path", "lang", "ident", "start_idx", "end_idx", "body"]
    rest = wanted if backend is None else wanted.join(backend.select("path").distinct(), "path", "left_anti")
    found = T.functions_of(contents(spark, root, rest))
    if backend is not None:
        found = found.unionByName(backend.join(wanted.select("path"), "path", "left_semi").select(*cols))
    return found.select(X.fqn(F.col("path"), F.col("ident")).alias("fqn"), *cols)


def extraction_faults(functions: DataFrame) -> DataFrame:
    """Functions whose body doesn't give exactly one function when extracted again: (path, ident, found).  Empty if sound."""
    again = T.functions_of(functions.select(F.concat_ws("#", "path", "ident").alias("path"), "lang", F.col("body").alias("content"))).groupBy("path").agg(F.count("*").alias("found"))
    key = functions.select("path", "ident", F.concat_ws("#", "path", "ident").alias("_k"))
    return key.join(again.withColumnRenamed("path", "_k"), "_k", "left").select("path", "ident", F.coalesce("found", F.lit(0)).alias("found")).filter("found <> 1")


def index_functions(nodes: DataFrame, contents: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Functions of an external code index: nodes (id, kind, qualified_name, file_path, language, start_line, end_line; lines
    from 1) with their slice of the text, numbered when a name repeats in a file."""
    from siltstone.operators.ordered import occurrence, with_suffix

    own = nodes.filter(F.col("kind").isin("function", "method"))
    if languages:
        own = own.filter(F.col("language").isin(languages))
    own = occurrence(own, ["file_path", "qualified_name"], ["start_line"], "_n")
    lines = contents.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("_l"))
    body = F.array_join(F.slice("_l", F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n")
    return own.join(lines, "file_path").select(
        "id", F.col("file_path").alias("path"), F.col("language").alias("lang"), with_suffix(F.col("qualified_name"), F.col("_n")).alias("ident"),
        (F.col("start_line") - 1).cast("int").alias("start_idx"), (F.col("end_line") - 1).cast("int").alias("end_idx"), body.alias("body"),
    )


def index_is_complete(meta: DataFrame, nodes: DataFrame) -> bool:
    """The marker decides if there is one; else whether there is any node."""
    state = meta.filter("key = 'index_state'").select("value").first()
    return state[0] == "complete" if state else not nodes.isEmpty()


def index_edges(nodes: DataFrame, edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst, kind, file, line, col): calls between indexed functions, and constructors of instantiated classes; sorted
    by place, each located site once."""
    from siltstone.operators.aggregates import dedupe_located

    f = functions.select("id", X.fqn(F.col("path"), F.col("ident")).alias("fqn"))
    a = f.select(F.col("id").alias("source"), F.col("fqn").alias("src"))
    b = f.select(F.col("id").alias("target"), F.col("fqn").alias("dst"))
    place = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file"), F.col("start_line").alias("_sl"))
    calls = edges.filter("kind = 'calls'").join(a, "source").join(b, "target").join(place, "source").select("src", "dst", F.lit("call").alias("kind"), "file", "line", "col")
    new = edges.filter("kind = 'instantiates'").select("source", F.col("target").alias("_class"), "line", "col")
    inside = edges.filter("kind = 'contains'").select(F.col("source").alias("_class"), "target")
    classes = nodes.select(F.col("id").alias("_class"), F.col("name").alias("_cn"))
    ctors = nodes.select(F.col("id").alias("target"), F.col("name").alias("_mn"), F.col("language").alias("_lang"))
    is_ctor = (F.col("_mn") == F.col("_cn")) | ((F.col("_lang") == "python") & (F.col("_mn") == "__init__")) | (F.col("_mn") == "constructor") | ((F.col("_lang") == "rust") & (F.col("_mn") == "new"))
    made = (
        new.join(classes, "_class").join(inside, "_class").join(ctors, "target").filter(is_ctor).join(a, "source").join(b, "target").join(place, "source")
        .select("src", "dst", F.lit("constructor").alias("kind"), "file", F.coalesce("line", "_sl").alias("line"), "col")
    )
    out = dedupe_located(calls.unionByName(made).filter("src <> dst"), ["src", "dst", "kind", "file", "line", "col"], F.col("line") > 0)
    return out.orderBy("file", F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0)), "src", "dst")
