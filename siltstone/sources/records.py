"""Writers of run records: payloads, lists of files, versions, clearing; and the reload of an estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import artifacts as A

ESTIMATE = "schema_version int, project string, scope string, analysis_stages string, estimate string"


def payloads(events: DataFrame, contents: DataFrame) -> DataFrame:
    """contents with ``content_ref``, the relative name of each payload: payloads/<event>_<name>; payloads of unknown events
    are left out.  events: (event_id); contents: (event_id, name, content)."""
    ref = F.concat(F.lit("payloads/"), F.col("event_id"), F.lit("_"), F.col("name"))
    return contents.withColumn("content_ref", ref).join(events.select("event_id").distinct(), "event_id", "left_semi")


def write_payloads(rows: DataFrame, path: str) -> None:
    """Append payloads as Parquet, one directory an event's first two characters, so that a reader of one event prunes the
    rest and no payload becomes a file of its own."""
    shard = F.substring(F.sha2(F.col("event_id"), 256), 1, 2)
    rows.withColumn("shard", shard).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def read_payload(spark: SparkSession, path: str, event_id: str) -> DataFrame:
    """Payloads of one event; only its directory is read."""
    shard = spark.range(1).select(F.substring(F.sha2(F.lit(event_id), 256), 1, 2)).first()[0]
    return spark.read.parquet(path).filter((F.col("shard") == shard) & (F.col("event_id") == event_id)).drop("shard")


def file_list(files: DataFrame) -> DataFrame:
    """Distinct paths without metadata files, sorted.  files: (path)."""
    return files.select("path").filter(~A.is_sidecar(F.col("path"))).distinct().orderBy("path")


def write_file_list(files: DataFrame, path: str) -> None:
    """The list as JSON lines in ranges of the order."""
    file_list(files).write.mode("overwrite").json(path)


def append_version(spark: SparkSession, version: str | None, path: str) -> None:
    """Append one version with the time of its run; nothing for an empty one."""
    if version:
        spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").json(path)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, at), oldest first."""
    return spark.read.schema("version string, at timestamp").json(path).orderBy("at", "version")


def cleared(artifacts: DataFrame, targets: DataFrame) -> DataFrame:
    """Artifacts but those of the targets' functions: verdicts, numbered candidates, validations, reports, probes.  Nothing is
    deleted: the result replaces the table.  artifacts: (path, ...); targets: (file), a verdict's path."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(\.result)?\.[^.]*$", "")
    bare = F.regexp_replace(stem, r"^(bug_validator_|probe_)", "")
    owner = F.regexp_replace(bare, r"\.bug-\d{3}$", "")
    verdict = F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), r"\.bug-\d{3}$", "")
    gone = targets.select(F.regexp_replace("file", r"\.[^./]*$", "").alias("_t"))
    flat = gone.select(F.replace("_t", F.lit("/"), F.lit("--")).alias("_f"))
    # Targets may be as many as artifacts, which their table's size doesn't tell: no broadcast.
    left = artifacts.withColumn("_t", verdict).withColumn("_f", owner).join(gone.hint("merge"), "_t", "left_anti")
    return left.join(flat.hint("merge"), "_f", "left_anti").select(artifacts.columns)


def is_estimate(schema: int) -> Column:
    """Whether a row read with ``ESTIMATE`` is a manifest of this schema and not a namesake."""
    return (
        (F.col("schema_version") == schema) & F.col("project").isNotNull() & F.ltrim("scope").startswith("{")
        & F.ltrim("analysis_stages").startswith("[") & F.ltrim("estimate").startswith("{")
    )


def newer_estimate(spark: SparkSession, path: str, schema: int, since=None) -> DataFrame:
    """(schema_version, project, scope, analysis_stages, estimate, modified) of manifests that were modified after ``since``
    (a timestamp; none: all).  Files that aren't newer are skipped by their metadata."""
    reader = spark.read.schema(ESTIMATE).option("multiLine", True)
    if since is not None:
        reader = reader.option("modifiedAfter", since.strftime("%Y-%m-%dT%H:%M:%S"))
    rows = reader.json(path).select("*", F.col("_metadata.file_modification_time").alias("modified")).filter(is_estimate(schema))
    return rows if since is None else rows.filter(F.col("modified") > F.lit(since))
