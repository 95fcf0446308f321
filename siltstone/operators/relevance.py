"""Relevance of functions to a written intent: signals of the text, a base score, shares of callers, callees and classes.

The intent is one text, a parameter; its signals are small sets and enter the plan as literals, so scoring is one pass over
the functions without a join.  Only the typo-tolerant part leaves the JVM."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.words import NOISE, STOP
from siltstone.operators.ordered import top_k

#: Weights of the parts of a score.
TRACEBACK, QUOTED_NAME, QUOTED_BODY, DOTTED, PLAIN, PROSE_NAME, FUZZY, EXCEPTION, BODY = 10.0, 5.0, 2.0, 15.0, 3.0, 1.5, 1.4, 4.0, 1.0
FUZZY_LENGTH, FUZZY_LEAST = 5, 0.75
CALLEE_SHARE, CALLER_SHARE = 0.30, 0.20
CLASS_NAME, CLASS_DOC, CLASS_SHARE, CLASS_MOST = 6.0, 2.0, 0.40, 8.0

#: Patterns of an intent's tiers.
TRACEBACK_LINE = r"\bin (\w+)\s*\n"
QUOTED_SPAN, ROLE, QUOTED_WORD = r"`([^`]+)`", r"^[a-z]+:[a-z]+\s*", r"[a-zA-Z_][a-zA-Z0-9_]{1,}"
FENCED, FENCED_WORD = r"(?s)```.*?```", r"\b([a-zA-Z_][a-zA-Z0-9_]{2,})\b"
DOTTED_REFERENCE = r"\b([A-Z][a-zA-Z0-9]+)\.([a-z_][a-z0-9_]+)\b"
COMPOUND = r"\b([a-zA-Z_][a-zA-Z0-9_]*(?:[A-Z_][a-zA-Z0-9_]+)+)\b"
EXCEPTION_TYPE = r"\b([A-Z][a-zA-Z]+(?:Error|Exception|Warning))\b"
PROSE_WORD = r"\b([a-zA-Z]{4,})\b"

#: Makes a Java pattern's words and their borders those of Unicode, as Python's are.
UNICODE = "(?U)"


def _camel(word: str) -> list[str]:
    return re.sub(r"(?=[A-Z])", "_", word).lower().strip("_").split("_")


def signals(intent: str) -> dict[str, list[str]]:
    """Sorted names and words of an intent by tier, in lower case: functions of tracebacks (one for each spelling), names in
    backquotes, methods and classes of dotted references, compound names, exception types, words of prose."""
    quoted = [w for span in re.findall(QUOTED_SPAN, intent) for w in re.findall(QUOTED_WORD, re.sub(ROLE, "", span.strip()))]
    quoted += [w for block in re.findall(FENCED, intent) for w in re.findall(FENCED_WORD, block)]
    references = re.findall(DOTTED_REFERENCE, intent)
    compounds = re.findall(COMPOUND, intent)
    return {
        "traceback": sorted(w.lower() for w in set(re.findall(TRACEBACK_LINE, intent))),
        "quoted": sorted({w for w in (q.lower().strip("_") for q in quoted) if len(w) > 1} - set(NOISE) - set(STOP)),
        "dotted": sorted({m for _, m in references} | {p for _, m in references for p in m.split("_") if len(p) > 1}),
        "dotted_class": sorted({c.lower() for c, _ in references}),
        "plain": sorted({w.lower() for w in compounds} | {p for w in compounds for p in _camel(w) if len(p) > 2}),
        "exception": sorted({w.lower() for w in re.findall(EXCEPTION_TYPE, intent)}),
        "prose": sorted(set(re.findall(PROSE_WORD, intent.lower())) - set(STOP)),
    }


def tier_columns(text: Column) -> dict[str, Column]:
    """``signals`` of a text column, tier by tier, unordered."""
    find = lambda c, pattern, group: F.regexp_extract_all(c, F.lit(UNICODE + pattern), F.lit(group))
    lower = lambda a: F.transform(a, F.lower)
    longer = lambda a, n: F.filter(a, lambda p: F.length(p) > n)
    spans = F.flatten(F.transform(find(text, QUOTED_SPAN, 1), lambda s: find(F.regexp_replace(F.trim(s), ROLE, ""), QUOTED_WORD, 0)))
    blocks = F.flatten(F.transform(find(text, FENCED, 0), lambda s: find(s, FENCED_WORD, 1)))
    quoted = F.transform(F.concat(spans, blocks), lambda w: F.regexp_replace(F.lower(w), "^_+|_+$", ""))
    methods, compounds = find(text, DOTTED_REFERENCE, 2), find(text, COMPOUND, 1)
    camel = F.flatten(F.transform(compounds, lambda w: F.split(F.lower(F.regexp_replace(w, "([A-Z])", "_$1")), "_")))
    out = {
        "traceback": lower(F.array_distinct(find(text, TRACEBACK_LINE, 1))), "quoted": F.array_except(longer(quoted, 1), _words(NOISE + STOP)),
        "dotted": F.concat(methods, longer(F.flatten(F.transform(methods, lambda m: F.split(m, "_"))), 1)), "dotted_class": lower(find(text, DOTTED_REFERENCE, 1)),
        "plain": F.concat(lower(compounds), longer(camel, 2)), "exception": lower(find(text, EXCEPTION_TYPE, 1)), "prose": prose_words(text),
    }
    return {t: c if t == "traceback" else F.array_distinct(c) for t, c in out.items()}


def name_parts(name: Column) -> Column:
    """Distinct parts of a name: the whole in lower case, snake parts of two letters or more, neighbouring pairs of them, and
    camel parts."""
    long = lambda a: F.filter(a, lambda p: F.length(p) > 1)
    snake = long(F.split(F.lower(name), "_"))
    pairs = F.transform(F.slice(snake, 1, F.greatest(F.size(snake) - 1, F.lit(0))), lambda p, i: F.concat_ws("_", p, F.get(snake, i + 1)))
    camel = long(F.split(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), "_"))
    return F.array_distinct(F.concat(F.array(F.lower(name)), snake, pairs, camel))


def _words(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _shared(have: Column, values) -> Column:
    return F.size(F.array_intersect(have, _words(values))).cast("double")


def prose_words(text: Column) -> Column:
    """Distinct words of four letters or more that aren't stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(UNICODE + PROSE_WORD), F.lit(1)), _words(STOP))


def exact_score(parts: Column, idents: Column, words: Column, exceptions: Column, lines: Column, s: dict[str, list[str]]) -> Column:
    """The base score but for its typo-tolerant part: weighted sizes of what name, body and exceptions share with the signals;
    body words count by the root of the body's length.  Null arrays count as empty."""
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    specific = F.filter(parts, lambda p: F.length(p) >= FUZZY_LENGTH)
    return (
        F.size(F.filter(_words(s["traceback"]), lambda w: F.array_contains(parts, w))) * TRACEBACK + _shared(parts, s["quoted"]) * QUOTED_NAME + _shared(some(idents), s["quoted"]) * QUOTED_BODY
        + _shared(parts, s["dotted"]) * DOTTED + _shared(parts, s["plain"]) * PLAIN + _shared(specific, s["prose"]) * PROSE_NAME
        + _shared(some(exceptions), s["exception"]) * EXCEPTION + _shared(some(words), s["prose"]) / F.sqrt(F.greatest(lines, F.lit(1))) * BODY
    )


def _fuzzy_words(s: dict[str, list[str]]) -> set[str]:
    found = {w for t in ("quoted", "plain", "dotted", "prose") for w in s[t]}
    return {w for w in found if len(w) >= FUZZY_LENGTH} - set(STOP) - set(NOISE)


def fuzzy(parts: list[str], wanted: set[str]) -> float:
    """Sum over the wanted words that no part equals of their closest part's likeness, where it is close enough; parts that
    are wanted themselves don't count."""
    own = {p for p in parts if len(p) >= FUZZY_LENGTH} - set(STOP) - set(NOISE)
    total = 0.0
    for word in sorted(wanted - own):
        best = 0.0
        for p in own - wanted:
            if 2 * min(len(p), len(word)) >= FUZZY_LEAST * (len(p) + len(word)):
                best = max(best, SequenceMatcher(None, word, p).ratio())
        if best >= FUZZY_LEAST:
            total += FUZZY * best
    return total


def fuzzy_score(parts: Column, s: dict[str, list[str]]) -> Column:
    """``fuzzy`` as a column; names repeat, so each distinct list of parts in a batch is compared once."""
    wanted = _fuzzy_words(s)

    @F.pandas_udf("double")
    def score(lists):
        import pandas as pd

        memo: dict[tuple, float] = {}
        return pd.Series([memo[k] if (k := tuple(x)) in memo else memo.setdefault(k, fuzzy(list(k), wanted)) for x in lists], dtype="float64")

    return score(parts)


def base_scores(functions: DataFrame, intent: str) -> DataFrame:
    """functions with ``base``.  functions: (path, name, first, last, calls, idents, words, exceptions)."""
    s = signals(intent)
    with_parts = functions.withColumn("_parts", name_parts(F.col("name")))
    exact = exact_score(F.col("_parts"), F.col("idents"), F.col("words"), F.col("exceptions"), F.col("last") - F.col("first") + 1, s)
    return with_parts.withColumn("base", exact + fuzzy_score(F.col("_parts"), s)).drop("_parts")


def class_bonus(classes: DataFrame, intent: str) -> DataFrame:
    """(path, first, bonus): for each method line the capped share of its classes' scores, which come from the class's name
    and docstring.  classes: (path, name, docstring, method_lines)."""
    s = signals(intent)
    parts = name_parts(F.col("name"))
    score = (
        _shared(parts, s["quoted"]) * QUOTED_NAME + _shared(parts, s["plain"]) * CLASS_NAME + _shared(parts, s["prose"]) * CLASS_NAME
        + _shared(parts, s["dotted_class"]) * DOTTED + _shared(prose_words(F.coalesce("docstring", F.lit(""))), s["prose"]) * CLASS_DOC
    )
    share = classes.select("path", F.explode("method_lines").alias("first"), F.least(score * CLASS_SHARE, F.lit(CLASS_MOST)).alias("bonus"))
    return share.filter("bonus > 0").groupBy("path", "first").agg(F.sum("bonus").alias("bonus"))


def call_bonus(scored: DataFrame) -> DataFrame:
    """(path, first, bonus): shares of the base scores of callers and callees in the same file.  Scores are summed by the
    called name before they meet the functions of that name, so no pair of functions is formed.
    scored: (path, name, first, calls, base)."""
    lit = scored.filter("base > 0")
    asked = lit.select("path", F.explode(F.array_distinct("calls")).alias("name"), "base").groupBy("path", "name").agg((F.sum("base") * CALLEE_SHARE).alias("bonus"))
    down = scored.select("path", "name", "first").join(asked, ["path", "name"]).select("path", "first", "bonus")
    worth = lit.groupBy("path", "name").agg((F.sum("base") * CALLER_SHARE).alias("bonus"))
    up = scored.select("path", "first", F.explode(F.array_distinct("calls")).alias("name")).join(worth, ["path", "name"]).select("path", "first", "bonus")
    return down.unionByName(up).groupBy("path", "first").agg(F.sum("bonus").alias("bonus"))


def ranked(functions: DataFrame, classes: DataFrame, intent: str, k: int) -> DataFrame:
    """(path, name, first, last, score, rank): the k most relevant functions of each file, one a name (its best, then the
    earliest); score to three places.  functions and classes as above."""
    scored = base_scores(functions, intent)
    bonus = call_bonus(scored).unionByName(class_bonus(classes, intent)).groupBy("path", "first").agg(F.sum("bonus").alias("bonus"))
    full = scored.join(bonus, ["path", "first"], "left").withColumn("score", F.round(F.col("base") + F.coalesce("bonus", F.lit(0.0)), 9))
    one = full.groupBy("path", "name").agg(F.min(F.struct((-F.col("score")).alias("s"), "first", "last")).alias("_o"))
    out = one.select("path", "name", F.col("_o.first").alias("first"), F.col("_o.last").alias("last"), (-F.col("_o.s")).alias("score"))
    return top_k(out, ["path"], [F.desc("score"), F.col("first")], k).withColumn("score", F.round("score", 3))
