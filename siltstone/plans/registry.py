"""The catalogue: queries by name, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder, read on first use."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, place: f(Tables(spark, place))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def k_of(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


def bucket(k):
    """A status from a number below 100."""
    return F.when(k < 70, "success").when(k < 85, "mismatch").when(k < 95, "error").otherwise("format_error")


#: The same in DuckDB.
K = "cast(json_extract_string(props, '$.k') as int)"
BUCKET = f"case when {K} < 70 then 'success' when {K} < 85 then 'mismatch' when {K} < 95 then 'error' else 'format_error' end"
EV = f"(select event_id, ts, user_id, event_type, value, {K} k, {BUCKET} status from events)"
