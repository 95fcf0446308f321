"""Grouped summaries: pivots over fixed lists, roll-ups with totals, last record wins, ranges, ordered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_pivot(df: DataFrame, group: str, status: str, groups: list[str], statuses: list[str]) -> DataFrame:
    """Counts by group and status for a fixed list of both; missing ones are 0, others aren't shown."""
    counts = df.groupBy(group).agg(*(F.count_if(F.col(status) == s).alias(s) for s in statuses))
    rows = df.sparkSession.createDataFrame([(g,) for g in groups], f"{group} string")
    return F.broadcast(rows).join(counts, group, "left").select(group, *(F.coalesce(s, F.lit(0)).alias(s) for s in statuses))


def rollup_total(df: DataFrame, group: str, sums: dict[str, Column], total: str = "TOTAL") -> DataFrame:
    """Sums by group and a grand total row."""
    out = df.rollup(group).agg(*(c.alias(n) for n, c in sums.items()), F.grouping(group).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, total).otherwise(F.col(group)).alias(group), *sums)


def elapsed_span(df: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """First start, last end and the microsecond difference in seconds."""
    span = df.agg(F.min(start).alias("first_start"), F.max(end or start).alias("last_end"))
    return span.withColumn("seconds", F.expr("timestampdiff(MICROSECOND, first_start, last_end) / 1e6"))


def counters(df: DataFrame, group: list[str], **conditions: Column) -> DataFrame:
    """One conditional count for each named condition."""
    return df.groupBy(*group).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def outcome_counts(results: DataFrame, calls: DataFrame, key: str, status: str) -> DataFrame:
    """By substring, as a dashboard reads statuses: 'not' first, then 'confirm', all else is not confirmed; pending is
    max(0, calls - results).  Every key with a call has a row."""
    has_not, has_confirm = F.lower(status).contains("not"), F.lower(status).contains("confirm")
    seen = results.groupBy(key).agg(
        F.count_if(~has_not & has_confirm).alias("confirmed"), F.count_if(has_not | ~has_confirm).alias("not_confirmed"), F.count("*").alias("results")
    )
    asked = calls.groupBy(key).agg(F.count("*").alias("calls"))
    return asked.join(seen, key, "left").select(
        key, F.coalesce("confirmed", F.lit(0)).alias("confirmed"), F.coalesce("not_confirmed", F.lit(0)).alias("not_confirmed"),
        F.greatest(F.lit(0), F.col("calls") - F.coalesce("results", F.lit(0))).alias("pending"),
    )


def run_summary(df: DataFrame, group: str, order: list[str], time: str, tokens: Column, cost: Column, model: Column) -> DataFrame:
    """Per run: first and last time, calls, tokens, the first model that is known, and the cost, which is unknown as soon as
    one used record has no price."""
    first = F.min(F.when(model.isNotNull(), F.struct(*order, model.alias("model"))))
    return df.groupBy(group).agg(
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), first.alias("_m"),
        F.when(F.bool_and(cost.isNotNull() | (F.coalesce(tokens, F.lit(0)) == 0)), F.sum(F.coalesce(cost, F.lit(0.0)))).alias("cost"),
    ).withColumn("model", F.col("_m.model")).drop("_m")


def last_wins(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last record of each key, at the place where the key first stood (columns ``first_<order>``); keys that are null
    or empty go."""
    present = df.filter(" and ".join(f"{k} is not null and cast({k} as string) <> ''" for k in key))
    out = present.groupBy(*key).agg(F.max(F.struct(*order, *values)).alias("_last"), F.min(F.struct(*order)).alias("_first"))
    return out.select(*key, *(F.col(f"_last.{v}").alias(v) for v in values), *(F.col(f"_first.{o}").alias(f"first_{o}") for o in order))


def scale_factor(target: Column, sample: Column, target_files: Column, sample_files: Column) -> Column:
    """target / sample of functions, else of files, else 1; clamped to 0.1 .. 10."""
    by = lambda a, b: F.when((a > 0) & (b > 0), a / b)
    ratio = F.coalesce(by(target, sample), by(target_files, sample_files))
    return F.when(ratio.isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(0.1), ratio))).otherwise(1.0)


def historical_range(df: DataFrame, group: list[str], value: str, whole: bool = False) -> DataFrame:
    """low and high of an envelope over samples: one sample is widened by a quarter, several by a tenth beyond their least
    and greatest; rounded half to even at nine places.  Whole numbers go down to at least 0 and up to at least 1."""
    least, most, n = F.min(value), F.max(value), F.count(value)
    low = F.bround(F.when(n == 1, least * 0.75).when(n > 1, least * 0.9), 9)
    high = F.bround(F.when(n == 1, most * 1.25).when(n > 1, most * 1.1), 9)
    if whole:
        low, high = F.greatest(F.floor(low), F.lit(0)), F.greatest(F.ceil(high), F.lit(1))
    return df.groupBy(*group).agg(n.alias("samples"), low.alias("low"), high.alias("high"))


def kind_counts(df: DataFrame, kind: str, shown: Column) -> DataFrame:
    """All rows and shown rows by kind."""
    return df.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(shown).alias("shown"))


def merge_edges(df: DataFrame, key: list[str], order: str, first: str, names: str) -> DataFrame:
    """One row a key: the first value of ``first`` and the distinct names in the order in which they first stood."""
    seen = df.groupBy(*key, names).agg(F.min(order).alias("_at"), F.min(F.struct(order, first)).alias("_f"))
    out = seen.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", names))).alias("_n"), F.min("_f").alias("_f"))
    return out.select(*key, F.col(f"_f.{first}").alias(first), F.col(f"_n.{names}").alias(names))


def dedupe_located(df: DataFrame, key: list[str], located: Column) -> DataFrame:
    """Rows with a location once for each key and location; rows without one are all kept."""
    return df.filter(located).dropDuplicates(key).unionByName(df.filter(~F.coalesce(located, F.lit(False))))


def adjacency(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Sorted distinct neighbours."""
    return edges.select(src, dst).distinct().groupBy(src).agg(F.array_sort(F.collect_list(dst)).alias("neighbours"))


def minimal_prefixes(paths: DataFrame, path: str) -> DataFrame:
    """Paths without an ancestor in the set; '.' covers nothing but itself.  Each path looks up its own ancestors, so the
    join is on equality and the work grows with the depth, not with the square of the set."""
    every = paths.select(path).distinct()
    parts = F.split(path, "/")
    ups = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    ancestors = every.filter(F.col(path).contains("/")).select(path, F.explode(ups).alias("_up"))
    covered = ancestors.join(every.filter(F.col(path) != ".").withColumnRenamed(path, "_up"), "_up", "left_semi").select(path)
    return every.join(covered, path, "left_anti")


def first_owner(df: DataFrame, item: str, order: list[str], owner: list[str]) -> DataFrame:
    """The owner of each item that comes first."""
    out = df.groupBy(item).agg(F.min(F.struct(*order, *[o for o in owner if o not in order])).alias("_o"))
    return out.select(item, *(F.col(f"_o.{o}").alias(o) for o in owner))


def hit_rate(read: Column, total: Column) -> Column:
    """Sum of reads by sum of totals; null when there is nothing."""
    return F.try_divide(F.sum(read), F.sum(total))


def cache_savings(read: Column, input_price: Column, read_price: Column, cost: Column) -> tuple[Column, Column]:
    """What reads from a cache saved, and its share of what would have been paid."""
    saved = F.sum(read * (input_price - read_price))
    return saved, F.try_divide(saved, F.sum(cost) + saved)


def merge_groups(df: DataFrame, order: list[str], text: str, items: str) -> DataFrame:
    """All rows as one: texts joined and lists concatenated in order.  For plans, which are small."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, text, items))).alias("_r"))
    return rows.select(F.array_join(F.col(f"_r.{text}"), "\n").alias(text), F.flatten(F.col(f"_r.{items}")).alias(items))
