"""Connected components of an edge table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import discard, written


def _distinct_edges(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stats(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs, either order, repeats and loops allowed.  Returns (node, component), component being the
    smallest node reachable; nodes without an edge to another node are absent.

    Alternating large-star and small-star rounds: each links the neighbours of a node to their least one, which keeps
    components and never adds edges; every round is written to the shared folder.  It ends when edges stand still.
    """
    now = written(_distinct_edges(edges), "edges")
    seen = _stats(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _distinct_edges(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        before, now = now, written(_distinct_edges(small), "edges")
        discard(before)
        if seen == (seen := _stats(now)):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
