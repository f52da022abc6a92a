"""Event time, incremental loads and joins over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.operators import incremental
from loomsieve.tables import table


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return e.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "users")


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users still to do: those whose last outcome so far is missing or an error."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    done = e.filter("event_id % 2 = 0")
    return incremental.pending(e.select("user_id").distinct(), done, "user_id", "event_id", F.col("event_type") != "error")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures united with later missing ones; the later row of a key counts."""
    e = table(spark, sf_dir, "events")
    failed = e.filter("event_type = 'error'").select("user_id", F.lit("failure").alias("reason"), F.col("event_id").alias("pos"))
    missing = e.filter("value < 2").select("user_id", F.lit("missing").alias("reason"), F.col("event_id").alias("pos"))
    return incremental.latest(failed.unionByName(missing), "user_id", "pos").groupBy("reason").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each user in order, until the first success or the third attempt."""
    e = table(spark, sf_dir, "events")
    out = incremental.attempts(e, "user_id", "event_id", F.col("event_type") == "purchase", 3)
    return out.groupBy("n_attempts", "outcome").agg(F.count("*").alias("n"))


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last signup at or before every purchase."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    out = incremental.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id")), "user_id", "ts", ["signup_id"])
    return out.select("event_id", "signup_id")


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = incremental.running(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", "event_type")
    return out.select("event_id", F.round("running", 4).alias("running"), "before", "after", F.col("first").alias("first_id"))


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_session, resume_pending, dead_letters, retry_rounds, asof_orders, running_totals)}
ORACLE = {
    "events_tumbling": "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "events_sliding": "select s as start, count(*) as n, count(distinct user_id) as users from (select user_id, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval '1 day']) as s from events) group by 1",
    "events_session": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '12 hours' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""",
    "resume_pending": "with l as (select user_id, arg_max(event_type, event_id) as t from events where event_id % 2 = 0 group by 1) select user_id from (select distinct user_id from events) u left join l using (user_id) where t is null or t = 'error'",
    "dead_letters": "with u as (select user_id, 'failure' as reason, event_id as pos from events where event_type = 'error' union all select user_id, 'missing', event_id from events where value < 2), l as (select user_id, arg_max(reason, (pos, reason)) as reason, max(pos) as pos from u group by 1) select reason, count(*) as n, max(pos) as last_pos from l group by 1",
    "retry_rounds": """with r as (select user_id, event_type = 'purchase' as ok, row_number() over (partition by user_id order by event_id) as k from events),
f as (select user_id, min(case when ok then k end) as first_ok, count(*) as c from r group by 1), a as (select least(coalesce(first_ok, c), 3, c)::bigint as n_attempts, case when first_ok <= 3 then 'done' when c >= 3 then 'gave_up' else 'open' end as outcome from f) select n_attempts, outcome, count(*) as n from a group by 1, 2""",
    "asof_orders": "select p.event_id, s.signup_id from (select * from events where event_type = 'purchase') p asof left join (select user_id, ts, max(event_id) as signup_id from events where event_type = 'signup' group by 1, 2) s on p.user_id = s.user_id and p.ts >= s.ts",
    "running_totals": "select event_id, round(sum(value) over w, 4) as running, lag(event_type) over (partition by user_id order by ts, event_id) as before, lead(event_type) over (partition by user_id order by ts, event_id) as after, first_value(event_id) over w as first_id from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)",
}
