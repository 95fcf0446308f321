"""Native word arrays: no Python on the executors."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything in ASCII but letters and digits parts words; everything outside ASCII belongs to them.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def with_words(df: DataFrame, text: str = "text", out: str = "w", ascii_only: bool = False) -> DataFrame:
    """Add the array of words of a text column, lower-cased (with ``ascii_only`` A-Z alone); empty for null, empty and
    word-less texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = df.withColumn("_cut", F.split(F.translate(whole, ascii_uppercase, ascii_lowercase) if ascii_only else F.lower(whole), GAP))
    first = F.when(F.get("_cut", F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size("_cut") > 1) & (F.element_at("_cut", -1) == ""), 1).otherwise(0)
    return cut.withColumn(out, F.slice("_cut", first + 1, F.greatest(F.size("_cut") - first - last, F.lit(0)))).drop("_cut")


def rolling(words: str, width: int) -> Column:
    """64-bit hashes of all ``width`` consecutive elements of an array column, in order; none if it is shorter."""
    span = lambda x, i: F.xxhash64(x, *(F.get(F.col(words), i + k) for k in range(1, width)))
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0))), span)
