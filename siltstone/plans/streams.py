"""Queries over streams that resume; each runs under a name of its own, to the end of what there is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.registry import k_of, query
from siltstone.streaming import durable as D


def _folder(df: DataFrame, name: str, files: int) -> str:
    """The rows as files of a folder that a stream can read."""
    at = f"{D.place_of(df.sparkSession, name)}/in"
    df.repartition(files).write.parquet(at)
    return at


@query("select distinct doc_id::varchar as file from labels where doc_id in (select doc_id from documents where doc_id % 2 = 0)")
def stream_ready(t):
    """Labels as signs that a document is ready, each three times; every second document is expected and handed on once."""
    name = f"ready-{uuid.uuid4().hex}"
    signs = t.labels.select(F.col("doc_id").cast("string").alias("file")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("_n")
    at = _folder(signs, name, 3)
    stream = t.spark.readStream.schema("file string").option("maxFilesPerTrigger", 1).parquet(at)
    D.watch_ready(stream, t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("file")), lambda batch: None, name)
    return D.handed(t.spark, name).select("file")


@query("""with e as (select event_type, user_id, event_id, cast(json_extract_string(props, '$.k') as int) k from events),
m as (select *, last_value(case when k < 40 then (event_id, 'm' || k % 7) end ignore nulls) over (partition by event_type, user_id order by event_id rows unbounded preceding) r from e)
select event_type as file, user_id::varchar as id, event_id::double as at, r[1]::double as request_at, case when k % 5 = 0 then 'own' else r[2] end as model from m where k >= 40""")
def stream_matched(t):
    """Events as requests and responses by type and user; each response with the last request's model unless it has its own."""
    name, k = f"matched-{uuid.uuid4().hex}", k_of()
    model = F.when(k < 40, F.concat(F.lit("m"), (k % 7).cast("string"))).when(k % 5 == 0, "own")
    rows = t.events.select(F.col("event_type").alias("file"), F.col("user_id").cast("string").alias("id"), F.when(k < 40, "request").otherwise("response").alias("kind"), F.col("event_id").cast("double").alias("at"), model.alias("model"))
    stream = t.spark.readStream.schema(rows.schema).parquet(_folder(rows, name, 4))
    D.append_to(D.match_requests(stream, None), name).awaitTermination()
    return D.appended(t.spark, name, "file string, id string, at double, request_at double, model string")


@query("select event_type, count(*) n, round(sum(value), 2) total from events where event_id % 3 > 0 group by 1")
def stream_recounted(t):
    """Counts that every tick makes anew: the table grew and then shrank, and only what is there at last counts."""
    name = f"ticks-{uuid.uuid4().hex}"
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    for left in ("event_id % 3 = 1", "true", "event_id % 3 > 0"):
        D.tick(t.spark, lambda left=left: t.events.filter(left), count, name)
    return D.current(t.spark, name)


@query("select o_orderstatus, count(*) n, sum((o_totalprice * 100)::bigint)::bigint cents from orders group by 1")
def stream_overlapped(t):
    """Orders that one query writes while another sums them up, batch by batch."""
    name = f"overlapped-{uuid.uuid4().hex}"
    rows = t.orders.select("o_orderstatus", "o_totalprice")
    source = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(_folder(rows, name, 6))
    sums = f"{D.place_of(t.spark, name)}/sums"
    total = lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    D.overlapped(source, lambda batch, i: total(batch).write.mode("overwrite").parquet(f"{sums}/batch={i}"), name, 2, lambda df: df.select("o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")))
    return t.spark.read.parquet(sums).groupBy("o_orderstatus").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
