"""Verdicts and validations: completeness, pending detection, roll-ups and report items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators.ordered import rank_in

#: Order of statuses in reports.
ORDER = {"analysis": ["MATCH", "MISMATCH", "ERROR", "SKIPPED"], "bug": ["confirmed", "not_confirmed", "error", "pending"]}
GAPS = ["spec_claim", "actual_behavior", "code_evidence", "trigger_condition"]


def complete_results(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """verdicts with ``complete``: records of one bug are when they have a verdict; records of all bugs when finished, typed,
    and their candidates are exactly numbers 1 to bug_count, each with four gaps that aren't blank.
    verdicts: (file, verdict, all_bugs, bug_count, reasoning_complete); candidates: (file, n, gaps...)."""
    filled = F.lit(True)
    for g in GAPS:
        filled = filled & (F.trim(F.coalesce(g, F.lit(""))) != "")
    c = candidates.groupBy("file").agg(F.array_sort(F.collect_set("n")).alias("_have"), F.bool_and(filled).alias("_filled"))
    want = F.when(F.col("bug_count") > 0, F.sequence(F.lit(1), F.col("bug_count"))).otherwise(F.array().cast("array<int>"))
    whole = (
        F.col("reasoning_complete") & F.col("bug_count").isNotNull() & ((F.col("verdict") == "MISMATCH") == (F.col("bug_count") > 0))
        & (F.coalesce("_have", F.array().cast("array<int>")) == want) & F.coalesce("_filled", F.lit(True))
    )
    done = F.when(F.col("all_bugs"), F.coalesce(whole, F.lit(False))).otherwise(F.col("verdict").isin("MATCH", "MISMATCH", "ERROR"))
    return verdicts.join(c, "file", "left").withColumn("complete", F.coalesce(done, F.lit(False))).drop("_have", "_filled")


def check_resume_mode(verdicts: DataFrame, all_bugs: bool) -> DataFrame:
    """The verdicts; reading them fails if one was made in the other mode."""
    other = F.coalesce("all_bugs", F.lit(False)) != F.lit(all_bugs)
    return verdicts.withColumn("file", F.when(other, F.raise_error(F.lit("results of the other mode exist"))).otherwise(F.col("file")))


def incomplete(files: DataFrame, verdicts: DataFrame, validations: DataFrame) -> DataFrame:
    """Files without a complete verdict, or with a mismatch that has no finished validation.  verdicts: (file, verdict,
    complete); validations: (file) of finished ones."""
    done = verdicts.filter("complete")
    bare = done.filter("verdict = 'MISMATCH'").join(validations, "file", "left_anti").select("file")
    return files.join(done.select("file"), "file", "left_anti").select("file").unionByName(files.join(bare, "file", "left_semi").select("file"))


def validation_targets(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(file, target): candidates where a mismatch has them, else the verdict itself."""
    bad = verdicts.filter("verdict = 'MISMATCH'").select("file")
    c = bad.join(candidates.select("file", "target"), "file")
    return c.unionByName(bad.join(c.select("file").distinct(), "file", "left_anti").select("file", F.col("file").alias("target")))


def summary(bugs: DataFrame) -> DataFrame:
    """total_reported, confirmed, not_confirmed, error, pending."""
    s = F.col("status")
    return bugs.agg(F.count("*").alias("total_reported"), *(F.count_if(s == x).alias(f"total_{x}") for x in ORDER["bug"]))


def mismatches(verdicts: DataFrame) -> DataFrame:
    """Number of mismatches: bugs where a complete record of all bugs counts them, else records."""
    return verdicts.filter("verdict = 'MISMATCH'").agg(F.coalesce(F.sum(F.when(F.col("all_bugs") & F.col("reasoning_complete"), F.col("bug_count")).otherwise(1)), F.lit(0)).alias("mismatches"))


def _detail(*pairs):
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in pairs))
    return F.map_from_entries(F.filter(entries, lambda e: F.coalesce(F.trim(e["v"]) != "", F.lit(False))))


def bug_items(bugs: DataFrame) -> DataFrame:
    """Report items of bugs: (id, status, source_file, function_name, trigger_summary, detail_file, md)."""
    return bugs.select(
        F.lit("bug").alias("kind"), "id", F.coalesce(F.nullif("trigger_summary", F.lit("")), "id").alias("title"), F.coalesce("status", F.lit("pending")).alias("status"),
        "source_file", "function_name", _detail(("Trigger", "trigger_summary"), ("Probe", "detail_file")).alias("detail"), F.coalesce("md", "detail_file").alias("detail_ref"),
    )


def analysis_items(verdicts: DataFrame) -> DataFrame:
    """Report items of verdicts: (file, function, verdict, gaps, error)."""
    source = F.coalesce(X.fqn_source(F.col("function")), F.regexp_replace("file", "/[^/]*$", ""))
    v = verdicts.select("*", *(F.col(f"gaps.{g}").alias(f"_{g}") for g in GAPS))
    return v.select(
        F.lit("analysis").alias("kind"), X.bug_id(F.col("file")).alias("id"), F.col("function").alias("title"), F.coalesce("verdict", F.lit("ERROR")).alias("status"),
        source.alias("source_file"), F.element_at(F.split("function", "::"), -1).alias("function_name"),
        _detail(("Claim", "_spec_claim"), ("Behaviour", "_actual_behavior"), ("Evidence", "_code_evidence"), ("Trigger", "_trigger_condition"), ("Error", "error")).alias("detail"), F.col("file").alias("detail_ref"),
    )


def with_locations(items: DataFrame, spans: DataFrame) -> DataFrame:
    """Add ``location``, the first line: of the span with the exact name or one that ends with ::name, else of the N-th of
    that bare name, N from the suffix.  spans: (source_file, ident, first)."""
    from siltstone.operators.ordered import occurrence

    s = occurrence(spans.withColumn("bare", F.element_at(F.split("ident", "::"), -1)), ["source_file", "bare"], ["first"], "n")
    exact = items.select("id", "source_file", "function_name").join(s, "source_file").filter("ident = function_name or endswith(ident, concat('::', function_name))").groupBy("id").agg(F.min("first").alias("_a"))
    parts = items.select("id", "source_file", F.regexp_replace("function_name", r"_\d+$", "").alias("bare"), F.coalesce(F.expr(r"try_cast(regexp_extract(function_name, '_(\\d+)$', 1) as int)"), F.lit(0)).alias("n"))
    nth = parts.join(s.select("source_file", "bare", "n", "first"), ["source_file", "bare", "n"]).groupBy("id").agg(F.min("first").alias("_b"))
    return items.join(exact, "id", "left").join(nth, "id", "left").withColumn("location", F.coalesce("_a", "_b")).drop("_a", "_b")


def source_href(path, prefix: str = "../"):
    """A relative link; null for null, empty and absolute paths and those that leave the tree."""
    return F.when((path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), ".."), F.concat(F.lit(prefix), path))


def filtered(items: DataFrame, kinds: list[str], statuses: list[str] = (), files: list[str] = (), text: str = "") -> DataFrame:
    """Items of these kinds, statuses and files (none given: all) with the text in title, file, function or location."""
    out = items.filter(F.col("kind").isin(list(kinds)))
    if statuses:
        out = out.filter(F.col("status").isin(list(statuses)))
    if files:
        out = out.filter(F.col("source_file").isin(list(files)))
    return out.filter(X.search(text, "title", "source_file", "function_name", *(["location"] if "location" in items.columns else [])))


def in_order(items: DataFrame) -> DataFrame:
    """By kind, place of the status in its kind's order, id."""
    rank = F.when(F.col("kind") == "analysis", rank_in(F.col("status"), ORDER["analysis"])).otherwise(rank_in(F.col("status"), ORDER["bug"]))
    return items.orderBy("kind", rank, "id")


#: Places of statuses in a list sorted by status, bugs before analyses; others come last.
STATUS_PLACES = {"confirmed": 0, "not_confirmed": 1, "error": 2, "pending": 3, "MATCH": 10, "MISMATCH": 11, "ERROR": 12, "SKIPPED": 13}


def utf16_key(text):
    """A text that sorts as the UTF-16 units of ``text`` do, as lists in browsers are sorted."""
    return F.hex(F.encode(text, "UTF-16BE"))


def sort_key(by: str):
    """The key that puts items in order by status, file, function or location, ties by kind and id: a struct to sort by.
    Items without a location follow the others, in the report's own order; a location may have lines before and after."""
    rank = F.when(F.col("kind") == "analysis", rank_in(F.col("status"), ORDER["analysis"])).otherwise(rank_in(F.col("status"), ORDER["bug"]))
    first_line = F.nullif(F.regexp_extract("location", r"L(\d+)", 1), F.lit("")).cast("long")
    place = F.lit(99)
    for status, n in STATUS_PLACES.items():
        place = F.when(F.col("status") == status, n).otherwise(place)
    own = {
        "status": [place], "file": [utf16_key(F.coalesce("source_file", F.lit("")))], "function": [utf16_key(F.coalesce("function_name", F.lit("")))],
        "location": [F.coalesce(first_line, F.lit((1 << 63) - 1)), F.when(first_line.isNull(), F.struct(F.col("kind"), rank.alias("rank")))],
    }
    if by not in own:
        raise ValueError(f"items are sorted by {', '.join(own)}")
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(own[by])), utf16_key(F.col("kind")).alias("kind"), utf16_key(F.col("id")).alias("id"))


def sorted_items(items: DataFrame, by: str = "status") -> DataFrame:
    """Add ``place``, from 1, of each item in that order; see ``sort_key``."""
    from siltstone.operators.ordered import renumber

    return renumber(items.withColumn("_key", sort_key(by)), "_key", "place").drop("_key")


def summary_document(bugs: DataFrame):
    """One row (json): the totals and the bugs, confirmed ones first, then not confirmed, errors and others, by id.
    bugs: (id, status, ...).  For summaries, which people read whole."""
    order = F.struct(rank_in(F.col("status"), ORDER["bug"][:3], 3).alias("o"), F.coalesce("id", F.lit("")).alias("i"), F.struct(*bugs.columns).alias("bug"))
    totals = [F.count("*").alias("total_reported"), *(F.count_if(F.col("status") == x).alias(f"total_{x}") for x in ORDER["bug"][:3])]
    return bugs.agg(*totals, F.transform(F.array_sort(F.collect_list(order)), lambda x: x["bug"]).alias("bugs")).select(F.to_json(F.struct("total_reported", "total_confirmed", "total_not_confirmed", "total_error", "bugs")).alias("json"))


def options(items: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't empty, in the order of their UTF-16 units."""
    return items.select(column).filter(f"{column} <> ''").distinct().orderBy(utf16_key(F.col(column)))
