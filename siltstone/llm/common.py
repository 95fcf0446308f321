"""Shared plumbing: table readers, tables written to the shared folder, batch helpers and size checks."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has no more than this many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's own reader (the path may be in any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a new temporary one on a local master (one
    machine, as in tests) and an error on any other."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """``df`` (a written table, so the count is cheap) with a broadcast hint if its size is proven to be small."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


#: Rows of an Arrow batch at most: texts of some kilobytes make Spark's default of 10,000 rows a large buffer, of which a
#: task holds several, in the JVM and in Python.
ARROW_ROWS = 1000


def docs_of(df: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, the whole text with null as the empty text, and ``columns``; any other column is dropped.  The session's
    Arrow batches are held to ``ARROW_ROWS`` rows from here on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)


def batches(it: Iterator, most_bytes: int = 1 << 18) -> Iterator[tuple]:
    """Arrow batches as (batch, lo, hi, data, offsets): rows lo..hi of about ``most_bytes`` of text, or one long row.

    data: the UTF-8 bytes of these rows as uint8, offsets: hi - lo + 1 positions in it.
    """
    import numpy as np
    import pyarrow as pa

    for batch in it:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        if not len(text):
            continue
        if text.null_count:
            text = text.fill_null(b"")
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1)
            hi = min(hi, len(text))
            yield batch, lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python process, so that the tasks of a reused worker share it.  Whoever
    fills it bounds its size."""
    home = sys.modules.setdefault("_siltstone_process_cache", types.ModuleType("_siltstone_process_cache"))
    return home.__dict__.setdefault(name, {})


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished stages now: they go when the driver's garbage is collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
