"""Streams drained into tables, and source round trips, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.plans.registry import register
from stepweave.session import table
from stepweave.sources import jsonl
from stepweave.sources.places import work_dir
from stepweave.streaming import events as E


def _replayed(spark, sf_dir, name, files=4, columns=("*",)):
    """A table as files that a stream reads one after another."""
    path = work_dir(spark, f"stream-{name}")
    rows = table(spark, sf_dir, name).select(*columns)
    if "ts" in rows.columns:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(files, "ts", "event_id")
    else:
        rows = rows.repartition(files)
    rows.write.parquet(f"{path}/in")
    return E.file_stream(spark, f"{path}/in", rows.schema), path


@register("stream_dedup", "select distinct lower(trim(regexp_replace(text, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'))) as norm from documents")
def stream_dedup(spark, sf_dir):
    stream, path = _replayed(spark, sf_dir, "documents", columns=("doc_id", "text"))
    return E.drained(E.new_texts(stream, "text").select("norm"), spark, path).select("norm")


@register(
    "stream_status",
    """
select user_id, cast(count(*) as bigint) as n, case arg_max(event_type, (ts, event_id)) when 'purchase' then 'Done' when 'error' then 'Error' else 'Running' end as status from events group by user_id
""",
)
def stream_status(spark, sf_dir):
    """The state that the last update of each task leaves."""
    stream, path = _replayed(spark, sf_dir, "events", columns=("event_id", "ts", "user_id", "event_type"))
    updates = E.drained(E.status_updates(stream, "400 days"), spark, path, "update").where("status <> 'Frozen'")
    return updates.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("status", "n").alias("status"))


@register(
    "stream_windows",
    """
select time_bucket(interval '1 hour', ts) as window_start, event_type, cast(count(*) as bigint) as n, round(avg(value), 6) as mean_value from events group by 1, 2
""",
)
def stream_windows(spark, sf_dir):
    """Extension: tumbling counts under a watermark; the last state of each window."""
    stream, path = _replayed(spark, sf_dir, "events", columns=("event_id", "ts", "event_type", "value"))
    rows = E.drained(E.tumbling(stream, "ts", "1 hour", "400 days", "event_type"), spark, path, "update")
    last = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "mean_value"), "batch").alias("s"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "s.n", F.round("s.mean_value", 6).alias("mean_value"))


@register("batch_sliding", "with s as (select unnest(generate_series(time_bucket(interval '10 minutes', ts) - interval '20 minutes', time_bucket(interval '10 minutes', ts), interval '10 minutes')) as window_start, value from events) select window_start, cast(count(*) as bigint) as n, round(avg(value), 6) as mean_value from s group by 1")
def batch_sliding(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    return E.sliding(rows, "ts", "30 minutes", "10 minutes", "1 day").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("mean_value", 6).alias("mean_value"))


@register(
    "batch_sessions",
    """
with g as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval '12 hours' then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as window_start, cast(count(*) as bigint) as n from s group by user_id, k
""",
)
def batch_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    return E.session_counts(rows, "ts", "12 hours", "1 day", "user_id").select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@register("stream_rules")
def stream_rules(spark, sf_dir):
    stream, path = _replayed(spark, sf_dir, "events", columns=("event_id", "ts", "user_id", "event_type"))
    return E.drained(E.rule_triggers(stream), spark, path).select("user_id", "event_id", "rule")


@register("stream_static_join", "select e.event_id, c.c_mktsegment from events e left join customer c on c.c_custkey = e.user_id")
def stream_static_join(spark, sf_dir):
    stream, path = _replayed(spark, sf_dir, "events", columns=("event_id", "ts", "user_id"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return E.drained(E.with_lookup(stream, customers, "user_id").select("event_id", "c_mktsegment"), spark, path).select("event_id", "c_mktsegment")


@register("source_jsonl_round_trip", "select event_id, user_id, event_type from events")
def source_jsonl_round_trip(spark, sf_dir):
    path = work_dir(spark, "jsonl")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").write.json(path)
    return jsonl.strict(spark, path, "event_id long, user_id long, event_type string")
