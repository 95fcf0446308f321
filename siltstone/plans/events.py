"""Queries over events: telemetry roll-ups, windows by count, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import expressions as X
from siltstone.operators import aggregates as A
from siltstone.operators import ordered as O
from siltstone.operators import relations as R
from siltstone.plans.registry import BUCKET, EV, K, Tables, bucket, k_of, query

STAGES = ["signup", "view", "click", "purchase", "error", "refund"]
STATUSES = ["success", "mismatch", "error", "format_error"]


def events(t: Tables) -> DataFrame:
    e = t.events.withColumn("k", k_of())
    return e.select("event_id", "ts", "user_id", "event_type", "value", "k", bucket(F.col("k")).alias("status"))


@query(f"""select s.stage event_type, {", ".join(f"count(*) filter (status = '{s}') as {s}" for s in STATUSES)}
from (select unnest({STAGES}) stage) s left join {EV} e on e.event_type = s.stage group by 1""")
def stage_status_pivot(t):
    return A.status_pivot(events(t), "event_type", "status", STAGES, STATUSES)


@query("""select min(ts) first_start, max(ts) last_end, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 3) as "seconds" from events""")
def elapsed_span(t):
    return A.elapsed_span(t.events, "ts").withColumn("seconds", F.round("seconds", 3))


@query(f"select event_type, count(*) filter (status = 'success' and user_id % 2 = 0) matched, count(*) filter (status = 'mismatch') mismatched, count(*) filter (status in ('error', 'format_error')) failed from {EV} group by 1")
def verdict_counters(t):
    s = F.col("status")
    return A.counters(events(t), ["event_type"], matched=(s == "success") & (F.col("user_id") % 2 == 0), mismatched=s == "mismatch", failed=s.isin("error", "format_error"))


@query(f"""with e as {EV}, p as (select *, case when k % 10 = 0 then null else k * 0.01 end price, case when k % 3 = 0 then null else 'm' || (k % 7) end model from e)
select user_id, min(ts) first_time, max(ts) last_time, count(*) calls, sum(k)::bigint tokens,
 case when bool_and(price is not null or k = 0) then round(sum(coalesce(price, 0.0)), 4) end as cost, arg_min(model, (ts, event_id)) filter (model is not null) model from p group by 1""")
def run_summary(t):
    e = events(t)
    price = F.when(F.col("k") % 10 != 0, F.col("k") * 0.01)
    model = F.when(F.col("k") % 3 != 0, F.concat(F.lit("m"), (F.col("k") % 7).cast("string")))
    out = A.run_summary(e, "user_id", ["ts", "event_id"], "ts", F.col("k"), price, model)
    return out.withColumn("cost", F.round("cost", 4))


@query(f"with e as {EV} select user_id, event_type, arg_max(k, (ts, event_id)) k, arg_max(status, (ts, event_id)) status, min(ts) first_ts, arg_min(event_id, (ts, event_id)) first_event_id from e group by 1, 2")
def history_last_wins(t):
    return A.last_wins(events(t), ["user_id", "event_type"], ["ts", "event_id"], ["k", "status"])


@query("select user_id, max(value) best from events group by 1")
def best_score_per_path(t):
    return t.events.groupBy("user_id").agg(F.max("value").alias("best"))


@query(f"""with o as (select *, row_number() over (order by ts desc, event_id desc) n from {EV} x where k > 0)
select w as part, round(sum(k) / sum(k + 10), 9) rate, count(*) calls from o, (select unnest([10, 100, 1000000000]) w) where n <= w group by 1""")
def cache_hit_latest(t):
    used = events(t).filter("k > 0")
    rate = lambda df, n: df.agg(F.lit(n).alias("part"), F.round(A.hit_rate(F.col("k"), F.col("k") + 10), 9).alias("rate"), F.count("*").alias("calls"))
    return rate(O.last_n(used, ["ts", "event_id"], 10), 10).unionByName(rate(O.last_n(used, ["ts", "event_id"], 100), 100)).unionByName(rate(used, 1000000000))


@query(f"select event_type, round(sum(k * 0.02), 6) saved, round(sum(k * 0.02) / (sum(k * 0.03) + sum(k * 0.02)), 9) share from {EV} group by 1")
def cache_savings(t):
    saved, share = A.cache_savings(F.col("k"), F.lit(0.03), F.lit(0.01), F.col("k") * 0.03)
    return events(t).groupBy("event_type").agg(F.round(saved, 6).alias("saved"), F.round(share, 9).alias("share"))


@query(f"select avg(case when status = 'success' then 1.0 else 0.0 end) rate, count(*) calls from (select * from {EV} order by ts desc, event_id desc limit 80)")
def success_rate_last80(t):
    latest = O.last_n(events(t), ["ts", "event_id"], 80)
    return latest.agg(F.avg((X.status_code(F.col("status")) == "200").cast("double")).alias("rate"), F.count("*").alias("calls"))


@query("select event_id, ts, event_type from events order by ts desc, event_id desc limit 40")
def recent_events(t):
    return O.last_n(t.events.select("event_id", "ts", "event_type"), ["ts", "event_id"], 40)


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts, event_id) n from events) where n = 4")
def nth_match(t):
    return O.nth(t.events, ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "ts")


@query(f"""select event_id, case status when 'error' then 0 when 'mismatch' then 1 when 'success' then 2 else 99 end status_key, coalesce(user_id, 1e18)::double location_key from {EV}""")
def dynamic_sort_keys(t):
    return events(t).select("event_id", O.rank_in(F.col("status"), ["error", "mismatch", "success"]).alias("status_key"), F.coalesce(F.col("user_id").cast("double"), F.lit(1e18)).alias("location_key"))


@query("""with r as (select user_id, ts, event_id, case when event_type = 'purchase' then 1 else 0 end r, event_type, value from events where event_type in ('signup', 'purchase')),
x as (select *, max(case when r = 0 then ts end) over (partition by user_id order by ts, r desc rows between unbounded preceding and 1 preceding) q from r)
select user_id, ts, q request_order, coalesce(case when cast(value as bigint) % 2 = 0 then value end, (select any_value(s.value) from events s where s.event_type = 'signup' and s.user_id = x.user_id and s.ts = x.q)) as value
from (select user_id, ts, r, q, value from x) x where r = 1""".replace("cast(value as bigint)", "cast(floor(value) as bigint)"))
def request_response(t):
    requests = t.events.filter("event_type = 'signup'").select("user_id", "ts", "value")
    known = F.when(F.floor("value") % 2 == 0, F.col("value"))
    responses = t.events.filter("event_type = 'purchase'").select("user_id", "ts", known.alias("value"))
    return R.request_response(requests, responses, ["user_id"], "ts", ["value"])


@query(f"""select event_id, case when {K} % 4 = 0 then false else true end valid from events""")
def schema_valid(t):
    """Sidecars made from k: every fourth lacks a key, has one more or a number for a text."""
    k = k_of()
    good = F.to_json(F.struct(F.lit("f()").alias("signature"), F.lit("").alias("pre_condition"), F.col("event_type").alias("post_condition")))
    bad = (
        F.when(k % 12 == 0, F.to_json(F.struct(F.lit("f()").alias("signature"), F.lit("").alias("pre_condition"))))
        .when(k % 12 == 4, F.to_json(F.struct(F.lit("f()").alias("signature"), F.lit("").alias("pre_condition"), k.alias("post_condition"))))
        .otherwise(F.to_json(F.struct(F.lit("f()").alias("signature"), F.lit("").alias("pre_condition"), F.lit("").alias("post_condition"), F.lit(1).alias("extra"))))
    )
    return t.events.select("event_id", X.valid_spec(F.when(k % 4 == 0, bad).otherwise(good)).alias("valid"))


@query(f"select event_id, (k % 5 <> 0 and k % 7 <> 0) valid from {EV}")
def terminal_records(t):
    """Validation records made from k: every fifth has a boolean for attempts, every seventh another id."""
    e = events(t)
    texts = [F.lit("x").alias(n) for n in ("source_file", "function_name", "probe_script", "detail_file", "probe_stdout", "trigger_summary")]
    head = [F.when(F.col("k") % 7 == 0, "other").otherwise(F.col("event_id").cast("string")).alias("id"), F.lit("confirmed").alias("confirmation_status"), *texts]
    record = F.when(F.col("k") % 5 == 0, F.to_json(F.struct(*head, F.lit(True).alias("attempts")))).otherwise(F.to_json(F.struct(*head, F.lit(2).alias("attempts"))))
    e = e.select("event_id", F.col("event_id").cast("string").alias("key"), F.parse_json(record).alias("record"))
    return e.select("event_id", X.terminal_validation("record", "key").alias("valid"))


def _usage(t):
    """Usage records in four vendor shapes, by k."""
    k = F.col("k")
    shape = (
        F.when(k % 4 == 0, F.to_json(F.struct((k + 100).alias("input_tokens"), k.alias("output_tokens"), (k % 30).alias("cache_read_input_tokens"), F.lit(5).alias("cache_creation_input_tokens"))))
        .when(k % 4 == 1, F.to_json(F.struct((k + 100).alias("prompt_tokens"), k.alias("completion_tokens"))))
        .when(k % 4 == 2, F.to_json(F.struct((k + 100).alias("prompt_tokens"), k.alias("completion_tokens"), F.struct((k % 40).alias("cached_tokens")).alias("prompt_tokens_details"))))
        .otherwise(F.to_json(F.struct((k + 100).alias("prompt_tokens"), k.alias("completion_tokens"), (k % 40).alias("prompt_cache_hit_tokens"), (k + 100 - k % 40).alias("prompt_cache_miss_tokens"))))
    )
    return events(t).select("event_id", F.parse_json(shape).alias("u"))


def _usage_sql(nested_in: str, nested_read: str, hit_in: str) -> str:
    return f"""select event_id, case k % 4 when 2 then {nested_in} when 3 then {hit_in} else k + 100 end::bigint as input, k::bigint as output,
 case k % 4 when 0 then k % 30 when 2 then {nested_read} when 3 then k % 40 else 0 end::bigint cache_read, case k % 4 when 0 then 5 else 0 end::bigint cache_write from {EV}"""


@query(_usage_sql("k + 100 - k % 40", "k % 40", "k + 100 - k % 40"))
def usage_normalise_estimate(t):
    return _usage(t).select("event_id", X.usage_estimate("u").alias("x")).select("event_id", "x.*")


@query(_usage_sql("k + 100", "0", "k + 100 - k % 40"))
def usage_normalise_native(t):
    return _usage(t).select("event_id", X.usage_native("u").alias("x")).select("event_id", "x.*")


@query(_usage_sql("k + 100", "k % 40", "k + 100 - k % 40"))
def usage_normalise_agent(t):
    return _usage(t).select("event_id", X.usage_agent("u").alias("x")).select("event_id", "x.*")


@query(f"select event_id, case when k % 4 = 0 then round((k + 100) * 0.003 + k * 0.015 + (k % 30) * 0.0003 + 5 * 0.00375, 6) else 0.0 end cost from {EV}")
def usage_cost_raw(t):
    """Cost as a dashboard has it: from the first vendor's keys alone."""
    names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    raw = {n: F.coalesce(F.expr(f"try_variant_get(u, '$.{n}', 'bigint')"), F.lit(0)) for n in names}
    price = dict(zip(names, map(F.lit, (0.003, 0.015, 0.0003, 0.00375)), strict=True))
    return _usage(t).select("event_id", F.round(X.cost(raw, price), 6).alias("cost"))


@query(f"""select user_id, count(distinct event_type) = 5 equal, count(distinct event_type) filter (event_type in ('view', 'click')) = 2 covers from events group by 1""")
def superset_test(t):
    five = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    both = R.set_flags(t.events, ["user_id"], "event_type", five).select("user_id", "equal")
    return both.join(R.set_flags(t.events, ["user_id"], "event_type", F.array(F.lit("view"), F.lit("click"))).select("user_id", "covers"), "user_id")


@query(f"select event_id, {BUCKET} status, case {BUCKET} when 'success' then '200' when 'format_error' then 'FMT' else 'ERR' end code from events")
def status_codes(t):
    return events(t).select("event_id", "status", X.status_code(F.col("status")).alias("code"))


@query("select event_type, count(*) events, round(sum(value), 2) total, min(value) least, max(value) most from events group by 1")
def stream_counts(t):
    """The drained stream equals the batch aggregate."""
    from siltstone.streaming.telemetry import drained_counts

    return drained_counts(t.spark, f"{t.place}/events.parquet")
