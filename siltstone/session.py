"""Session settings and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; every count must be a positive integer."""

    granularity: int = 40
    batch_size: int = 2
    top_functions: int = 5
    cache_window: int = 200
    status_window: int = 80
    recent_window: int = 40

    def __post_init__(self):
        for name, value in vars(self).items():
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError(f"{name} must be a positive integer, not {value!r}")

    @classmethod
    def layered(cls, *layers: dict) -> Settings:
        """The first layer that has a name wins; unknown names are errors."""
        merged: dict = {}
        for layer in reversed(layers):
            merged |= {k: v for k, v in layer.items() if v is not None}
        if unknown := set(merged) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**merged)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for one machine: ANSI on, UTC, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where that is unset: a new temporary one on a local master, which is
    one machine, and an error on any other."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: iterations restart from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
