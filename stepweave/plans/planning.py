"""Planning, deduplication and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.functions import text as T
from stepweave.operators import messages, planning, steps
from stepweave.plans.registry import register
from stepweave.session import table

NORM = r"lower(trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')))"


@register(
    "plan_catch_up",
    """
with tasks as (select distinct user_id from events), points as (select distinct event_type from events),
existing as (select user_id, event_type, count(*) as n from events group by 1, 2)
select t.user_id, p.event_type, cast(coalesce(e.n, 0) as bigint) as existing, cast(20 - coalesce(e.n, 0) as bigint) as remaining
from tasks t cross join points p left join existing e on e.user_id = t.user_id and e.event_type = p.event_type
where 20 - coalesce(e.n, 0) > 0
""",
)
def plan_catch_up(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.agg(F.collect_set("event_type").alias("points"))  # the types of events: a handful
    tasks = events.select("user_id").distinct().join(F.broadcast(points)).select("user_id", F.explode("points").alias("event_type"))
    expected = tasks.withColumn("expected", F.lit(20).cast("long"))
    return planning.catch_up(expected, events, ["user_id", "event_type"]).select("user_id", "event_type", "existing", "remaining")


@register(
    "plan_skip_processed",
    "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
)
def plan_skip_processed(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return planning.skip_processed(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@register("plan_allow_list", "select event_id, user_id, event_type from events where user_id in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def plan_allow_list(spark, sf_dir):
    return planning.allow_list(table(spark, sf_dir, "events"), "user_id", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]).select("event_id", "user_id", "event_type")


@register("plan_allow_join", "select e.event_id, e.user_id from events e where exists (select 1 from customer c where c.c_custkey = e.user_id and c.c_mktsegment = 'BUILDING')")
def plan_allow_join(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(wanted, "user_id", "left_semi").select("event_id", "user_id")


@register("plan_unfinished", "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def plan_unfinished(spark, sf_dir):
    return planning.skip_processed(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@register(
    "plan_last_n_points",
    """
select user_id, event_id, event_type from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events
) where r <= 3
""",
)
def plan_last_n_points(spark, sf_dir):
    return planning.last_n(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "event_type")


@register("plan_limit", "select doc_id, source from documents order by doc_id limit 25")
def plan_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(25)


@register("seen_first_occurrence", f"select min(doc_id) as doc_id, cast(count(*) as bigint) as n_rows, {NORM} as norm from documents group by {NORM}")
def seen_first_occurrence(spark, sf_dir):
    return planning.first_occurrence(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@register("seen_against_store", f"select doc_id from documents where {NORM} not in (select {NORM} from benchmark)")
def seen_against_store(spark, sf_dir):
    return planning.not_in_store(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", table(spark, sf_dir, "benchmark"), "text").select("doc_id")


@register("seen_counts", f"select lang, cast(count(distinct {NORM}) as bigint) as n_distinct, cast(count(*) as bigint) as n_rows from documents group by lang")
def seen_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.xxhash64(T.normalized("text")).alias("h"))  # the text itself is not shuffled
    return rows.groupBy("lang").agg(F.count_distinct("h").alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"))


@register("seen_check_and_store", f"select min(doc_id) as doc_id, {NORM} as norm from documents where {NORM} not in (select {NORM} from benchmark) group by {NORM}")
def seen_check_and_store(spark, sf_dir):
    store = table(spark, sf_dir, "benchmark").select(T.normalized("text").alias("norm"))
    new, _ = planning.check_and_store(table(spark, sf_dir, "documents").select("doc_id", "text"), store, "text", "doc_id")
    return new.select("doc_id", "norm")


@register(
    "memory_insert_absent",
    "select item_id, text from benchmark union all select doc_id, text from documents where doc_id not in (select item_id from benchmark)",
)
def memory_insert_absent(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return planning.insert_if_absent(table(spark, sf_dir, "benchmark").select("item_id", "text"), rows, "item_id")


@register(
    "ctx_prefix",
    "select conv_id, turn, text from (select *, row_number() over (partition by conv_id order by turn) as r from conversations) where r <= 3 and text is not null and text <> '' and upper(trim(text)) <> 'DONE'",
)
def ctx_prefix(spark, sf_dir):
    first = planning.first_n(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3)
    return first.where("text is not null and text <> '' and upper(trim(text)) <> 'DONE'").select("conv_id", "turn", "text")


@register(
    "ctx_digest",
    "select conv_id, string_agg(case when length(text) > 200 then substr(text, 1, 200) || '...' else text end, chr(10) order by turn) as digest from conversations where text is not null group by conv_id",
)
def ctx_digest(spark, sf_dir):
    return messages.digest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@register(
    "ctx_last_actions",
    "select conv_id, string_agg(cast(turn as varchar) || ':' || role, ',' order by turn) as actions from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 10 group by conv_id",
)
def ctx_last_actions(spark, sf_dir):
    last = planning.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 10)
    line = F.struct("turn", F.concat(F.col("turn").cast("string"), F.lit(":"), "role").alias("l"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["l"]), ",").alias("actions"))


@register(
    "images_uniform",
    """
with n as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as c from conversations),
s as (select *, case when c > 3 then greatest(1, c // 3) else 1 end as stride from n)
select conv_id, turn from s where i % stride = 0 and i // stride < 3
""",
)
def images_uniform(spark, sf_dir):
    return steps.uniform_sample(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 3).select("conv_id", "turn")


SHOTS = [("step_3.png",), ("step_1_replay.png",), ("step_10.png",), ("notes.txt",), ("step_2_replay.png",), ("step_2.png",)]
SHOT_ROWS = ", ".join(f"('{n}')" for (n,) in SHOTS)


@register(
    "images_sorted",
    f"""
with f(name) as (values {SHOT_ROWS}),
p as (select name, coalesce(try_cast(nullif(regexp_extract(name, 'step_(\\d+)(_replay)?\\.png', 1), '') as integer), 1000000000) as step, contains(name, '_replay.png') as replay from f)
select name, cast(row_number() over (order by not replay, step, name) as bigint) as by_segment, cast(row_number() over (order by step, not replay, name) as bigint) as by_step from p
""",
)
def images_sorted(spark, sf_dir):
    from pyspark.sql import Window

    shots = spark.createDataFrame(SHOTS, "name string").withColumn("s", T.screenshot_step("name"))
    step, live = F.coalesce("s.step", F.lit(10**9)), ~F.col("s.replay")
    place = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("long")  # noqa: E731  the files of one directory
    return shots.select("name", place(live, step, "name").alias("by_segment"), place(step, live, "name").alias("by_step"))
