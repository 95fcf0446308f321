"""Cross-site boilerplate: lines that spread over many distinct sites are removed.

A HyperLogLog sketch of the sites is kept for each line hash; sketches are merged by aggregation, map-side first, so a line
in a third of all documents moves as one row a task.  Lines whose estimate is surely above the threshold are boilerplate,
those surely below are not, and lines near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltstone.llm.common import BROADCAST_BYTES, broadcast_if_small, docs_of, table, written

#: log2 of a sketch's registers (a standard error of 6.5 %), and the share of the threshold on either side of it within
#: which lines are counted exactly: more than four standard errors.
REGISTERS = 8
NEAR = 0.3

#: Distinct sites from which a line is boilerplate.
SITES = 8

_BLANK = " \t\r\f\x0b"


def _lines(docs: DataFrame) -> DataFrame:
    """One row for each line with anything but blanks: its position and a 96-bit key of the trimmed line."""
    cut = docs.select("doc_id", "__x", "__site", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = F.trim(F.col("line"), F.lit(_BLANK))
    return cut.select("doc_id", "__x", "__site", "at", line.alias("line")).filter("line <> ''").select(
        "doc_id", "__x", "__site", "at", F.xxhash64("line").alias("h"), F.crc32("line").alias("g")
    )


def boilerplate_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(h, g) of the lines in at least ``sites`` distinct sites; lines: (h, g, __site)."""
    spread = (
        lines.groupBy("h", "g").agg(F.hll_sketch_agg("__site", F.lit(REGISTERS)).alias("s"), F.count("*").alias("n"))
        .filter(F.col("n") >= sites).select("h", "g", F.hll_sketch_estimate("s").alias("e")).filter(F.col("e") >= sites * (1 - NEAR))
    )
    spread = written(spread, "spread")
    sure = spread.filter(F.col("e") > sites * (1 + NEAR)).select("h", "g")
    near = written(spread.filter(F.col("e") <= sites * (1 + NEAR)).select("h", "g"), "near")
    exact = lines.join(broadcast_if_small(near, 20), ["h", "g"], "left_semi").select("h", "g", "__site").distinct().groupBy("h", "g").count()
    return sure.unionByName(exact.filter(F.col("count") >= sites).select("h", "g"))


def _cut_in_place(docs: DataFrame, bad: DataFrame, keep: list[str]) -> DataFrame:
    """Texts stay where they are; the keys of the boilerplate lines are sent to them."""
    import numpy as np

    rows = bad.toPandas()
    order = np.lexsort((rows.g.to_numpy(), rows.h.to_numpy()))
    sent = docs.sparkSession.sparkContext.broadcast((rows.h.to_numpy(np.int64)[order], rows.g.to_numpy(np.int64)[order].astype(np.uint32)))
    columns = ["doc_id", "text", *keep]

    def run(it):
        import zlib

        import pyarrow as pa
        from xxhash import xxh64_intdigest

        keys, checks = sent.value
        for whole in it:
            for batch in (whole.slice(lo, 1000) for lo in range(0, whole.num_rows, 1000)):
                split = [x.as_py().split("\n") for x in batch.column(batch.schema.get_field_index("text"))]
                trimmed = [[line.strip(_BLANK).encode() for line in lines] for lines in split]
                flat = [line for lines in trimmed for line in lines]
                h = np.fromiter((xxh64_intdigest(line, 42) for line in flat), np.uint64, len(flat)).view(np.int64)
                first, end = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                gone = np.array([bool(e > f and line and zlib.crc32(line) in checks[f:e]) for f, e, line in zip(first, end, flat, strict=True)], bool)
                texts, n_lines, n_removed, i = [], [], [], 0
                for lines, stripped in zip(split, trimmed, strict=True):
                    mark = gone[i : i + len(lines)]
                    i += len(lines)
                    n, k = sum(1 for line in stripped if line), int(mark.sum())
                    n_lines.append(n)
                    n_removed.append(k if k < n else 0)
                    texts.append("\n".join(line for line, m in zip(lines, mark, strict=True) if not m) if 0 < k < n else None)
                column = batch.column(batch.schema.get_field_index("text"))
                cut = pa.array([t if t is not None else column[j].as_py() for j, t in enumerate(texts)], pa.string())
                out = {c: batch.column(batch.schema.get_field_index(c)) for c in columns} | {"text": cut}
                yield pa.RecordBatch.from_arrays([*out.values(), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=[*out, "n_lines", "n_removed"])

    docs = docs.select(*columns)
    shape = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return docs.mapInArrow(run, shape).select("doc_id", "text", "n_lines", "n_removed", *keep)


def _cut_by_join(docs: DataFrame, lines: DataFrame, bad: DataFrame, keep: list[str]) -> DataFrame:
    """For more boilerplate lines than can be sent: the places of lines are joined with them, and texts shuffled to those
    once."""
    hits = lines.join(bad, ["h", "g"], "left_semi")
    gone = hits.groupBy("doc_id", "__x").agg(F.collect_set("at").alias("gone"))
    parts = docs.alias("d").join(gone.alias("g"), (F.col("d.doc_id").eqNullSafe(F.col("g.doc_id"))) & (F.col("d.__x") == F.col("g.__x")), "left").select("d.*", "gone")
    split = F.split("text", "\n")
    n_lines = F.size(F.filter(split, lambda line: F.trim(line, F.lit(_BLANK)) != ""))
    touched = F.col("gone").isNotNull() & (F.size("gone") < n_lines)
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains("gone", i)), "\n")
    return parts.select(
        "doc_id", F.when(touched, kept).otherwise(F.col("text")).alias("text"), n_lines.cast("long").alias("n_lines"),
        F.when(touched, F.size("gone")).otherwise(0).cast("long").alias("n_removed"), *keep,
    )


def remove_boilerplate(documents: DataFrame, sites: int = SITES, site: str = "source", keep: list[str] | None = None, send: int = BROADCAST_BYTES) -> DataFrame:
    """Return doc_id, text (without boilerplate lines), n_lines (with anything but blanks), n_removed and the columns that
    ``keep`` names, for every row.

    Lines are compared trimmed of blanks; a null site is a site of its own; null and empty texts have no lines.  Boilerplate
    lines go whatever their share of the text; only a text of nothing but boilerplate and blank lines, of which nothing would
    remain, stays as it is and is left to document dedup.  Rows that repeat doc_id and text are treated alike.  Only the
    keys of boilerplate lines travel, while they have at most ``send`` bytes; beyond, texts are shuffled once.
    """
    keep = list(keep or ())
    docs = docs_of(documents, F.coalesce(F.col(site).cast("string"), F.lit("")).alias("__site"), *keep).withColumn("__x", F.xxhash64("text"))
    lines = _lines(docs)
    bad = written(boilerplate_lines(lines.select("h", "g", "__site"), sites), "boilerplate")
    if bad.count() * 16 <= send:
        return _cut_in_place(docs, bad, keep)
    return _cut_by_join(docs, lines, bad, keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: whole ``documents`` by ``source``."""
    return remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') t, coalesce(source, '') site, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, t, site, unnest(range(0, len(ls))) i, trim(unnest(ls), ' ' || chr(9) || chr(13) || chr(12) || chr(11)) line from d),
b as (select line from l where line <> '' group by 1 having count(distinct site) >= {SITES}),
n as (select doc_id, t, count(distinct i) n from l where line <> '' group by 1, 2),
g as (select doc_id, t, list(distinct i) gone from l semi join b using (line) group by 1, 2),
r as (select d.*, case when len(g.gone) < n then g.gone end gone from d left join g using (doc_id, t) left join n using (doc_id, t))
select doc_id, len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''))::bigint n_lines, coalesce(len(gone), 0)::bigint n_removed,
  md5(case when gone is null then t else coalesce(array_to_string(list_filter(ls, lambda x, i: not list_contains(gone, i - 1)), chr(10)), '') end) kept_md5
from r
"""
