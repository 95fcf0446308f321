"""Telemetry as a stream: counters and windows by time and count.  Each is run once, to the end of what there is, and ends
equal to its batch form; ``durable`` has the streams that resume."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import shared_dir
from siltstone.streaming.durable import match_requests, watch_ready  # noqa: F401  they belong to telemetry, too


def shared(spark: SparkSession, name: str) -> str:
    """A new folder for one run of a stream."""
    return f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str, format: str = "parquet", schema=None) -> DataFrame:
    """Files of a folder as a stream; offsets are in the checkpoint, so a restart reads no file twice."""
    schema = schema or spark.read.format(format).load(path).schema
    return spark.readStream.format(format).schema(schema).load(path)


def drain(stream: DataFrame, name: str, mode: str = "append", partition: list[str] | None = None) -> DataFrame:
    """Run the stream over all that is there now and return what it wrote."""
    spark = stream.sparkSession
    out = shared(spark, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
        writer.option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    else:
        # Complete mode: each batch replaces the result; the last one stays.
        state = {}

        def keep(batch: DataFrame, n: int):
            state["at"] = f"{out}/{n}"
            batch.write.mode("overwrite").parquet(state["at"])

        stream.writeStream.foreachBatch(keep).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).outputMode("complete").start().awaitTermination()
        out = state.get("at", out)
        if "at" not in state:
            return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(out)


def counts(events: DataFrame) -> DataFrame:
    """Counters, sums and extremes by type: the same plan for batches and streams."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def drained_counts(spark: SparkSession, path: str) -> DataFrame:
    """counts over a stream of the folder that has ``path``, to its end."""
    folder, _, name = path.rpartition("/")
    frame = spark.read.parquet(path)
    first = frame.select("_metadata.file_path").first()
    alone = first is not None and first[0].rpartition("/")[2] == name  # a single file: its folder is the source, narrowed to it
    stream = spark.readStream.schema(frame.schema).option("pathGlobFilter", name if alone else "*").parquet(folder if alone else path)
    return drain(counts(stream), "counts", "complete")


def windows(events: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by type and time window; rows later than the watermark don't count."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), "event_type").count().select("window.start", "window.end", "event_type", "count")


def last_n_per_batch(stream: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """A window by count: after each batch of this run the newest n rows of all so far.  State is those n rows."""
    from siltstone.operators.ordered import last_n

    spark, place, state = stream.sparkSession, shared(stream.sparkSession, name), {}

    def keep(batch: DataFrame, i: int):
        rows = batch if "at" not in state else batch.unionByName(spark.read.parquet(state["at"]))
        last_n(rows, order, n).write.mode("overwrite").parquet(f"{place}/{i}")
        state["at"] = f"{place}/{i}"

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", place + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(state["at"]) if state else spark.createDataFrame([], stream.schema)
