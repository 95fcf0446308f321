"""Numbering, frames by count, blocks and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import written


def occurrence(df: DataFrame, partition: list[str], order: list[str], out: str = "occurrence") -> DataFrame:
    """0-based number of the row in its partition."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def with_suffix(name: Column, n: Column) -> Column:
    """The name, with _n from the second occurrence on."""
    return F.when(n > 0, F.concat_ws("_", name, n.cast("string"))).otherwise(name)


def nth(df: DataFrame, partition: list[str], order: list[str], n: int) -> DataFrame:
    """The n-th row (from 0) of each partition."""
    return occurrence(df, partition, order, "_n").filter(F.col("_n") == n).drop("_n")


def last_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows, newest first: a top-k in each task and one merge of n rows a task, no sort of the whole."""
    return df.orderBy(*(F.desc(o) for o in order)).limit(n)


def renumber(df: DataFrame, order: str, out: str = "number") -> DataFrame:
    """1, 2, ... in order, over all rows.  Ranges are numbered side by side and written once: the counts of earlier ranges,
    which are added, come from the same rows, and no task holds more than its own range."""
    parts = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    ranked = written(parts.withColumn("_r", rank), "ranked")
    counts = ranked.groupBy("_p").agg(F.max("_r").alias("_c"))  # a row for each range
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_b"))
    return ranked.join(F.broadcast(before), "_p").withColumn(out, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def fixed_batches(df: DataFrame, partition: list[str], order: list[str], size: int) -> DataFrame:
    """Add batch (from 0 within the partition) and place (from 0 within the batch)."""
    n = occurrence(df, partition, order, "_n")
    return n.withColumn("batch", F.expr(f"cast(_n div {size} as int)")).withColumn("place", F.col("_n") % size).drop("_n")


def earlier(df: DataFrame, partition: list[str], order: Column, value: str) -> DataFrame:
    """Add earlier and best: how many rows of the partition come strictly before this one, and the largest value among them
    (null without any).  order: a long; rows of one place don't count for each other.  A running window, no pairs of rows."""
    before = Window.partitionBy(*partition).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_at", order).withColumns({"earlier": F.count("_at").over(before), "best": F.max(value).over(before)}).drop("_at")


def indexed_batches(df: DataFrame, partition: list[str], order: list[str], size: int) -> DataFrame:
    """``fixed_batches`` with batch_index, the batch's number over all partitions in their order, from 0.  The partitions'
    numbers of batches are summed up, a row each; the rows themselves aren't sorted as a whole."""
    batches = fixed_batches(df, partition, order, size)
    counts = renumber(df.groupBy(*partition).agg(F.struct(*partition).alias("_key"), F.ceil(F.count("*") / size).alias("_batches")), "_key", "_n")
    blocks = counts.withColumn("_block", F.floor(F.col("_n") / 10_000))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("_block").agg(F.sum("_batches").alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))  # a row for ten thousand partitions
    within = Window.partitionBy("_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_own", F.coalesce(F.sum("_batches").over(within), F.lit(0))).join(sums, "_block").select(*(F.col(c).alias(f"_p_{c}") for c in partition), (F.col("_own") + F.col("_ahead")).alias("_start"))
    same = F.lit(True)
    for c in partition:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return batches.join(starts, same).withColumn("batch_index", (F.col("_start") + F.col("batch")).cast("long")).drop("_start", *(f"_p_{c}" for c in partition))


def numbered_lines(df: DataFrame, text: str) -> DataFrame:
    """One row for each line with anything but blanks, numbered from 1: line_no, line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return df.select(*[c for c in df.columns if c != text], F.posexplode(lines).alias("_i", "line")).withColumn("line_no", F.col("_i") + 1).drop("_i")


def _block_count(n: Column, size: int) -> Column:
    """Up to two sizes are one block; beyond, blocks of ``size`` are cut off while more than two sizes are left."""
    return F.when(n > 2 * size, F.ceil(n / size) - 1).otherwise(F.lit(1)).cast("int")


def block_of(i: Column, n: Column, size: int) -> Column:
    """Block of item i of n (from 0): blocks of ``size``, the last one with all of a rest of up to two sizes."""
    return F.least(F.floor(i / size), _block_count(n, size) - 1).cast("int")


def block_sizes(n: Column, size: int) -> Column:
    """Sizes of the blocks of n items, as an array."""
    blocks = _block_count(n, size)
    return F.transform(F.sequence(F.lit(1), blocks.cast("int")), lambda k: F.when(k < blocks, F.lit(size)).otherwise(n - (blocks - 1) * size).cast("int"))


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each partition with their 1-based rank; Spark limits groups before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(out) <= k)


def marked_top(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """Every row with its 1-based rank in the partition and ``marked``: whether it is one of the first k."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("rank", rank).withColumn("marked", F.col("rank") <= k)


def rank_in(value: Column, order: list[str], otherwise: int = 99) -> Column:
    """Place of a value in a fixed list; others last."""
    out = F.lit(otherwise)
    for i, v in reversed(list(enumerate(order))):
        out = F.when(value == v, i).otherwise(out)
    return out


def overflow(items: Column, k: int) -> Column:
    """The first k items joined, with the number of the rest."""
    rest = F.size(items) - k
    return F.concat(F.array_join(F.slice(items, 1, k), ", "), F.when(rest > 0, F.concat(F.lit(" +"), rest.cast("string"))).otherwise(F.lit("")))


def rank_merge(chosen: DataFrame, ranked: DataFrame, partition: str, name: str, k: int) -> DataFrame:
    """Chosen names first in their order, filled up to k from the ranked ones; chosen: (partition, name, place)."""
    both = chosen.select(partition, name, F.lit(0).alias("_s"), "place").unionByName(ranked.select(partition, name, F.lit(1).alias("_s"), "place"))
    first = both.groupBy(partition, name).agg(F.min(F.struct("_s", "place")).alias("_o"))
    return top_k(first, [partition], [F.col("_o"), F.col(name)], k).select(partition, name, "rank")
