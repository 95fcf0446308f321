"""Streams under stable names: killed and started again, they go on where they stopped.

All that a stream keeps lies below ``<spark.checkpoint.dir>/siltstone/streams/<name>``: Spark's checkpoint with offsets and keyed
state, and the tables that batches write.  A batch that runs again after a kill has its old number and rows, so it replaces
what it wrote before.  Keyed state lives in RocksDB, so a key costs disk and not memory.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from siltstone.session import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def place_of(spark: SparkSession, name: str) -> str:
    """The folder of a stream."""
    return f"{shared_dir(spark)}/siltstone/streams/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _parts(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries in order, '' folders and all; none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def keyed(spark: SparkSession) -> SparkSession:
    """The session with the store that ``transformWithState`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class _FirstOnly(StatefulProcessor):
    """A key's first row passes; the key is forgotten after ``keep_ms`` (None: never)."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        for _ in rows:
            pass
        if not self.seen.exists():
            self.seen.update((True,))
            yield pd.DataFrame({"file": [key[0]]})

    def close(self) -> None:
        pass


def first_of_each(stream: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(file): every file of a stream with a ``file`` column once, over all batches and restarts.  Null isn't a file."""
    keyed(stream.sparkSession)
    files = stream.select(F.col("file").cast("string").alias("file")).filter("file is not null")
    if not keep_ms:  # what is never forgotten needs no timers: Spark's own keyed state, without Python
        return files.dropDuplicates(["file"])
    return files.groupBy("file").transformWithStateInPandas(_FirstOnly(keep_ms), "file string", "append", "processingTime")


def watch_ready(stream: DataFrame, expected: DataFrame, handle: Callable[[DataFrame], None], name: str, keep_ms: int | None = None) -> bool:
    """Hand each ready and expected file on once, in batches, until the stream's files are used up; true when all that is
    expected was handed on, in this run or an earlier one of the same name.

    Which files were seen is keyed state, so a file that shows up again, in this run or after a restart, isn't handed on
    again.  A batch is recorded when ``handle`` has returned; one that was killed in ``handle`` is handed on as a whole when
    the stream is started again, and one that was killed after its record isn't."""
    spark, place = stream.sparkSession, place_of(stream.sparkSession, name)

    def step(batch: DataFrame, i: int):
        done = f"{place}/handed/batch={i}"
        if _exists(spark, f"{done}/_SUCCESS"):
            return
        batch.join(expected.select("file").distinct(), "file", "left_semi").write.mode("overwrite").parquet(f"{place}/new/{i}")
        new = spark.read.schema("file string").parquet(f"{place}/new/{i}")
        if not new.isEmpty():
            handle(new)
        new.write.mode("overwrite").parquet(done)
        _drop(spark, f"{place}/new/{i}")

    first_of_each(stream, keep_ms).writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return expected.join(handed(spark, name), "file", "left_anti").isEmpty()


def handed(spark: SparkSession, name: str) -> DataFrame:
    """(file, batch): what a watcher handed on so far."""
    at = f"{place_of(spark, name)}/handed"
    return spark.read.schema("file string, batch long").parquet(at) if _parts(spark, at) else spark.createDataFrame([], "file string, batch long")


def _nulls_last(record: tuple) -> tuple:
    """The order of a key's records in a batch: time, then kind."""
    at, kind, _ = record
    return at is None, 0.0 if at is None else at, kind is None, kind or ""


class _LastRequest(StatefulProcessor):
    """Responses with the model of the last request of their key, requests and responses ordered within a batch.  Records are
    plain rows: a frame for each key costs some 10 ms, and most keys have few records."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "request_at double, model string")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()  # None without one; every call is a way to the JVM and back
        found, newest = last, None if last is None else last[0]
        for at, kind, model in sorted(((r["at"], r["kind"], r["model"]) for r in rows), key=_nulls_last):
            newest = at if newest is None or at is not None and at > newest else newest
            if kind == "request":
                found = (at, model)
            else:
                request_at, of = found or (None, None)
                yield Row(file=key[0], id=key[1], at=at, request_at=request_at, model=of if model is None else model)
        if found is not None and found is not last:
            self.last.update(found)
        if self.forget_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(int(newest * 1000), timerValues.getCurrentWatermarkInMs()) + self.forget_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def match_requests(stream: DataFrame, forget_seconds: int | None = 3600) -> DataFrame:
    """(file, id, at, request_at, model): responses with the last earlier request of their (file, id) and, where they have no
    model, its model.  stream: (file, id, kind, at, model), at in seconds; of records of one time requests come first.

    A key's request is forgotten when the stream's newest records are ``forget_seconds`` later than the key's last one, and
    records that come so late are left out; None keeps every request for good."""
    keyed(stream.sparkSession)
    rows = stream.select("file", "id", "kind", F.col("at").cast("double").alias("at"), F.col("model").cast("string").alias("model"), F.timestamp_seconds("at").alias("time"))
    late = f"{forget_seconds if forget_seconds is not None else 0} seconds"
    timed = rows if forget_seconds is None else rows.withWatermark("time", late)
    forget = None if forget_seconds is None else forget_seconds * 1000
    out = timed.groupBy("file", "id").transformWithState(_LastRequest(forget), "file string, id string, at double, request_at double, model string", "append", "none" if forget is None else "eventTime")
    return out


def append_to(stream: DataFrame, name: str, available: bool = True) -> StreamingQuery:
    """Start appending a stream to its table under ``name``; each row is there once, also after restarts."""
    place = place_of(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("path", f"{place}/table").option("checkpointLocation", f"{place}/checkpoint").outputMode("append")
    return (writer.trigger(availableNow=True) if available else writer).start()


def appended(spark: SparkSession, name: str, schema) -> DataFrame:
    """The table of ``append_to``; no rows before its first batch."""
    at = f"{place_of(spark, name)}/table"
    return spark.read.schema(schema).parquet(at) if _exists(spark, f"{at}/_spark_metadata") else spark.createDataFrame([], schema)


def tick(spark: SparkSession, read: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], name: str, keep: int = 2) -> int:
    """Recompute a result from all that ``read`` finds now and publish it as the next version; the last ``keep`` versions
    stay for readers that have begun.  Nothing is added to earlier results, so a file that shrank or was written anew counts
    as it is now.  Returns the version."""
    at = f"{place_of(spark, name)}/versions"
    known = [int(p.partition("=")[2]) for p in _parts(spark, at) if p.startswith("version=")]
    version = max(known, default=0) + 1
    compute(read()).write.mode("overwrite").parquet(f"{at}/version={version}")
    for old in sorted(known)[: max(0, len(known) + 1 - keep)]:
        _drop(spark, f"{at}/version={old}")
    return version


def current(spark: SparkSession, name: str) -> DataFrame | None:
    """The newest version that was written whole; None if there is none."""
    at = f"{place_of(spark, name)}/versions"
    whole = [int(p.partition("=")[2]) for p in _parts(spark, at) if p.startswith("version=") and _exists(spark, f"{at}/{p}/_SUCCESS")]
    return spark.read.parquet(f"{at}/version={max(whole)}") if whole else None


def ticks(spark: SparkSession, read: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], name: str, every: str = "1500 milliseconds") -> StreamingQuery:
    """Start a stream that runs ``tick`` at that pace; a clock is its source, so a tick needs no new file.  A slow tick
    delays the next one and is never met by it."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    step = lambda batch, i: tick(spark, read, compute, name)
    return clock.writeStream.foreachBatch(step).option("checkpointLocation", f"{place_of(spark, name)}/clock").trigger(processingTime=every).start()


def overlapped(source: DataFrame, handle: Callable[[DataFrame, int], None], name: str, files_a_batch: int = 4, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Produce and consume at once: one query appends the (transformed) source to a table, another hands the table's rows to
    ``handle`` while the first still runs.  The consumer takes ``files_a_batch`` files at a time, so its lag shows as files and
    not as a batch that grows.  Returns the table when the producer has ended and all its rows were handed on.

    If one query fails, the other is stopped and the error raised; started again under the same name, both go on.  A batch
    number that was handled isn't handed on again."""
    spark, place = source.sparkSession, place_of(source.sparkSession, name)
    made = transform(source) if transform else source
    producer = append_to(made, name)
    table = None
    try:
        while not _exists(spark, f"{place}/table/_spark_metadata"):
            if not producer.isActive:
                producer.awaitTermination()
                if not _exists(spark, f"{place}/table/_spark_metadata"):
                    return spark.createDataFrame([], made.schema)
            time.sleep(0.05)
        table = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{place}/table")

        def step(batch: DataFrame, i: int):
            if _exists(spark, f"{place}/handled/{i}/_SUCCESS"):
                return
            handle(batch, i)
            spark.range(1).write.mode("overwrite").parquet(f"{place}/handled/{i}")

        consumer = table.writeStream.foreachBatch(step).option("checkpointLocation", f"{place}/consumer").start()
        try:
            while producer.isActive and consumer.isActive:
                producer.awaitTermination(1)
            if consumer.isActive:
                producer.awaitTermination()
                consumer.processAllAvailable()
            else:
                consumer.awaitTermination()
        finally:
            consumer.stop()
    finally:
        producer.stop()
    return spark.read.schema(made.schema).parquet(f"{place}/table")
