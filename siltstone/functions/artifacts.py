"""Column expressions on specifications, verdict texts and artifact paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import expressions as X

#: Endings of metadata files beside an extracted function.
SIDECARS = [".spec.json", ".info.json"]

#: The folder of extracted functions, and headings in specifications and verdict texts.
EXTRACTED = "/extracted_functions/"
PRE, POST = "Pre-condition:", "Post-condition:"
STATEMENTS, REASON = "Statements triggering the violation:", "Reason for violation:"
PASSED, FAILED = "passes the verification", "Failed to "

CALLEE = "struct<name:string,signature:string,pre_condition:string,post_condition:string>"
GAPS = "struct<spec_claim:string,actual_behavior:string,code_evidence:string,trigger_condition:string>"


def is_sidecar(path: Column) -> Column:
    out = F.lit(False)
    for s in SIDECARS:
        out = out | path.endswith(s)
    return out


def identity(path: Column) -> Column:
    """What follows the last folder of extracted functions in a path, with either slash; null without one."""
    whole = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    tail = F.substring_index(whole, EXTRACTED, -1)
    return F.when(whole.contains(EXTRACTED) & (tail != ""), tail)


def suffix(path: Column) -> Column:
    """The identity, else the path without leading slashes; '' for null."""
    return F.coalesce(identity(path), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""), F.lit(""))


def is_extracted(path: Column) -> Column:
    """Whether a suffix has a folder <base>-<known extension> above its last part."""
    known = "|".join(X.LANGUAGES)
    return F.exists(F.split(F.regexp_replace(path, "/?[^/]*$", ""), "/"), lambda p: p.rlike(f"^.+-({known})$"))


def source_of(path: Column) -> Column:
    """The source file of an extracted function's path: up to its last folder <base>-<ext>, as <base>.<ext>.  Other paths come
    back as suffixes."""
    known = "|".join(X.LANGUAGES)
    s = suffix(path)
    return F.when(is_extracted(s), F.regexp_replace(s, rf"^(.*[^/])-({known})/.*$", "$1.$2")).otherwise(s)


def rebound(stored: Column, current: Column) -> Column:
    """The current path where the stored one is the same function, else the stored one."""
    return F.when(identity(stored).eqNullSafe(identity(current)) & identity(stored).isNotNull(), current).otherwise(stored)


def _part(text: Column, pattern: str) -> Column:
    return F.regexp_replace(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)), r"^\s+|\s+$", "")


def conditions(spec: Column) -> Column:
    """struct(pre, post) of a specification's text; null where a heading is missing."""
    pre = _part(spec, rf"(?s){PRE}\s*\n(.*?)(?=\n{POST}|\z)")
    return F.struct(pre.alias("pre"), _part(spec, rf"(?s){POST}\s*\n(.*)").alias("post"))


def spec_text(signature: Column, pre: Column, post: Column) -> Column:
    """The text of a specification; null parts are empty."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(some(signature), F.lit(f"\n\n{PRE}\n"), some(pre), F.lit(f"\n\n{POST}\n"), some(post))


def last_by_name(callees: Column) -> Column:
    """Callees with one entry a name: the last one, at the place of the first."""
    names = F.array_distinct(F.transform(callees, lambda c: F.coalesce(c["name"], F.lit(""))))
    return F.transform(names, lambda n: F.element_at(F.filter(callees, lambda c: F.coalesce(c["name"], F.lit("")) == n), -1))


def info_text(callees: Column) -> Column:
    """The text of the callees' specifications, a paragraph each.  A callee with no signature is an empty line."""
    some = lambda c: F.coalesce(c, F.lit(""))
    entry = lambda c: F.concat(some(c["signature"]), F.lit(f"\n{PRE} "), some(c["pre_condition"]), F.lit(f"\n{POST} "), some(c["post_condition"]))
    return F.array_join(F.transform(last_by_name(callees), entry), "\n\n")


def supported_spec(json: Column) -> Column:
    """struct of the three texts of a specification's JSON; missing ones are ''."""
    s = F.from_json(json, "signature string, pre_condition string, post_condition string")
    return F.struct(*(F.coalesce(s[k], F.lit("")).alias(k) for k in ("signature", "pre_condition", "post_condition")))


def supported_info(json: Column) -> Column:
    """Callees of an info JSON with their four texts, missing ones ''; null if they aren't an array.  What isn't an object is
    left out."""
    items = F.from_json(F.get_json_object(json, "$.callees"), "array<string>")
    callees = F.transform(F.filter(items, lambda x: F.ltrim(x).startswith("{")), lambda x: F.from_json(x, "name string, signature string, pre_condition string, post_condition string"))
    clean = F.transform(callees, lambda c: F.struct(*(F.coalesce(c[k], F.lit("")).alias(k) for k in ("name", "signature", "pre_condition", "post_condition"))))
    return F.when(F.get_json_object(json, "$.callees").isNull(), F.array().cast(f"array<{CALLEE}>")).otherwise(clean)


def gaps(result: Column, claim: Column) -> Column:
    """struct(verdict, gaps, error) of a verdict's text: a match, a failure with its text, else a mismatch with the claim and
    the three stretches between headings ('' where one is missing)."""
    stretch = lambda pattern: F.coalesce(_part(result, pattern), F.lit(""))
    found = F.struct(
        F.coalesce(claim, F.lit("")).alias("spec_claim"), stretch(rf"(?s){POST}\n(.*?)\n\n{REASON}").alias("actual_behavior"),
        stretch(rf"(?s){STATEMENTS}\n(.*?)\n\n{POST}").alias("code_evidence"), stretch(rf"(?s){REASON}\n(.*)").alias("trigger_condition"),
    )
    verdict = F.when(result.contains(PASSED), "MATCH").when(result.startswith(FAILED), "ERROR").otherwise("MISMATCH")
    return F.struct(verdict.alias("verdict"), F.when(verdict == "MISMATCH", found).alias("gaps"), F.when(verdict == "ERROR", result).alias("error"))


def gaps_of(violations: Column, claim: Column) -> Column:
    """An array of gaps from an array of struct(statements, post_condition, reason); null counts as empty."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(
        F.coalesce(violations, F.array().cast("array<struct<statements:string,post_condition:string,reason:string>>")),
        lambda v: F.struct(some(claim).alias("spec_claim"), some(v["post_condition"]).alias("actual_behavior"), some(v["statements"]).alias("code_evidence"), some(v["reason"]).alias("trigger_condition")),
    )


def all_bugs_verdict(status: Column, complete: Column, n_gaps: Column) -> Column:
    """ERROR if the check didn't end, else MISMATCH with gaps, MATCH if it says so, else ERROR."""
    return F.when(~F.coalesce(complete, F.lit(False)) | (status == "ERROR"), "ERROR").when(n_gaps > 0, "MISMATCH").when(status == "MATCH", "MATCH").otherwise("ERROR")


def ascii_nested(column: Column, kind) -> Column:
    """The column with only ASCII characters in every text of a nested type (``kind``: its DataType)."""
    from pyspark.sql import types as Y

    if isinstance(kind, Y.StringType):
        return X.ascii_only(column)
    if isinstance(kind, Y.ArrayType):
        return F.transform(column, lambda x: ascii_nested(x, kind.elementType))
    if isinstance(kind, Y.MapType):
        return F.transform_values(column, lambda _, v: ascii_nested(v, kind.valueType))
    if isinstance(kind, Y.StructType):
        return F.when(column.isNotNull(), F.struct(*(ascii_nested(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return column


def merged_description(target: Column, source: Column) -> Column:
    """The source's description after the target's, unless it is blank or already contained."""
    add = F.regexp_replace(F.coalesce(source, F.lit("")), r"^\s+|\s+$", "")
    base = F.coalesce(target, F.lit(""))
    return F.when((add == "") | base.contains(add), target).when(base == "", add).otherwise(F.concat(base, F.lit("\n\n"), add))


def is_http_error(status: Column) -> Column:
    """A status that is given and isn't 200."""
    text = status.cast("string")
    return F.coalesce((text != "") & (text != "200"), F.lit(False))


def layer_range(text: Column, layers: Column) -> Column:
    """struct(first, last) of 'n' or 'a-b'; null if it isn't one, runs backwards or leaves 0 to layers - 1."""
    pattern = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"
    number = lambda g: F.regexp_extract(text, pattern, g).try_cast("int")
    first, last = number(1), F.coalesce(number(2), number(1))
    return F.when(text.rlike(pattern) & (first <= last) & (last < layers), F.struct(first.alias("first"), last.alias("last")))


def zipped(extensions: Column, languages: Column) -> Column:
    """Map from extension (lower case, no leading dots) to the language at its place; the last of repeated extensions wins."""
    pairs = F.slice(F.arrays_zip(extensions.alias("e"), languages.alias("l")), 1, F.least(F.size(extensions), F.size(languages)))
    clean = F.transform(pairs, lambda p: F.struct(F.regexp_replace(F.lower(p["e"]), r"^\.+", "").alias("e"), p["l"].alias("l")))
    keep = F.filter(clean, lambda p, i: ~F.exists(F.slice(clean, i + 2, F.size(clean)), lambda q: q["e"] == p["e"]))
    return F.map_from_entries(keep)
