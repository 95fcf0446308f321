"""Telemetry files: JSONL events, agent traces, and a tail that keeps byte offsets."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import expressions as X

EVENT = "event_id string, type string, stage string, status string, summary string, start_time string, end_time string, function_ids array<string>, children array<struct<type:string,role:string,label:string,path:string,content_ref:string>>, metadata string"


def events(spark: SparkSession, path: str) -> DataFrame:
    """Trace events of JSONL files; malformed and blank lines are skipped; times are instants, metadata is a VARIANT."""
    raw = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumns({c: F.try_to_timestamp(c) for c in ("start_time", "end_time")}).withColumn("metadata", F.try_parse_json("metadata"))


def agent_records(spark: SparkSession, folder: str) -> DataFrame:
    """(file, kind, id, ts, url, purpose, status, model, usage) of agent traces; keys may have a '*' or '+' before them."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.from_json("value", "map<string,string>").alias("r")).filter("r is not null")
    get = lambda k: X.trace_value("r", k)
    return raw.select("file", get("_kind").alias("kind"), get("_id").alias("id"), get("_ts").alias("ts"), get("_url").alias("url"), get("_purpose").alias("purpose"), get("_status").alias("status"), get("model").alias("model"), F.try_parse_json(get("usage")).alias("usage"))


class Tail:
    """New whole lines of growing files since the last call.  A last line without its end is held back; a file that shrank
    is read again from its start.  ``offsets`` (path: bytes) can be stored and given back."""

    def __init__(self, offsets: dict[str, int] | None = None):
        self.offsets = dict(offsets or {})

    def read(self, *paths: str) -> list[dict]:
        out = []
        for path in sorted(paths):
            try:
                size = os.path.getsize(path)
            except OSError:
                continue
            at = self.offsets.get(path, 0)
            at = 0 if size < at else at
            with open(path, "rb") as f:
                f.seek(at)
                data = f.read()
            end = data.rfind(b"\n") + 1
            self.offsets[path] = at + end
            for line in data[:end].splitlines():
                try:
                    value = json.loads(line)
                except ValueError:
                    continue
                if isinstance(value, dict):
                    out.append(value)
        return out


def tail_source(spark: SparkSession):
    """Register the streaming source ``jsonl_tail`` (option ``path``; one column ``value``): offsets are part of the stream's
    checkpoint, so growing files are read once and whole lines only."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, path):
            self.path = path

        def initialOffset(self):
            return {}

        def _files(self):
            return [os.path.join(self.path, n) for n in sorted(os.listdir(self.path)) if n.endswith(".jsonl")] if os.path.isdir(self.path) else [self.path]

        def read(self, start):
            tail = Tail(start)
            rows = [(json.dumps(r),) for r in tail.read(*self._files())]
            return iter(rows), tail.offsets

        def readBetweenOffsets(self, start, end):
            for path, stop in sorted(end.items()):
                at = start.get(path, 0)
                with open(path, "rb") as f:
                    f.seek(0 if stop < at else at)
                    data = f.read(stop if stop < at else stop - at)
                for line in data.splitlines():
                    try:
                        yield (json.dumps(json.loads(line)),)
                    except ValueError:
                        continue

        def commit(self, end):
            pass

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "jsonl_tail"

        def schema(self):
            return "value string"

        def simpleStreamReader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Source)


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input, output, cache_read, cache_write) with cost; null when a model has no price.  A read from the
    cache without a price of its own costs a tenth, a write the whole of an input token."""
    from siltstone.operators.relations import price_lookup

    p = prices.withColumn("price", F.struct(
        F.col("input_cost_per_token").alias("input"), F.col("output_cost_per_token").alias("output"),
        F.coalesce("cache_read_input_token_cost", F.col("input_cost_per_token") * 0.1).alias("cache_read"), F.coalesce("cache_creation_input_token_cost", "input_cost_per_token").alias("cache_write"),
    ))
    out = price_lookup(usage, "model", p, "model", "price") if "model" not in p.columns else price_lookup(usage, "model", p.withColumnRenamed("model", "_pm"), "_pm", "price")
    return out.withColumn("cost", X.cost({n: F.col(n) for n in ("input", "output", "cache_read", "cache_write")}, {n: F.col(f"price.{n}") for n in ("input", "output", "cache_read", "cache_write")}))
