"""Step windows and dataset builders; conversations stand for trajectories, turns for steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.functions import text as T
from stepweave.operators import planning
from stepweave.operators import steps as S
from stepweave.plans.registry import register
from stepweave.session import table

K, O = ["conv_id"], ["turn"]


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@register(
    "steps_history",
    """
select conv_id, turn, coalesce(string_agg(nullif(text, ''), chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') as history
from conversations
""",
)
def steps_history(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", S.history("text", K, O).alias("history"))


@register(
    "steps_text_window",
    """
with n as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as i from conversations)
select conv_id, turn, coalesce(string_agg('Step ' || cast(i as varchar) || ' reasoning: ' || coalesce(text, ''), chr(10)) over (partition by conv_id order by turn rows between 10 preceding and 1 preceding), 'None') as window_text from n
""",
)
def steps_text_window(spark, sf_dir):
    number = F.row_number().over(S.along(K, O))
    rows = conversations(spark, sf_dir).withColumn("i", number)
    return rows.select("conv_id", "turn", S.labelled_history("text", F.col("i"), K, O, 10).alias("window_text"))


@register(
    "steps_image_window",
    "select conv_id, turn, coalesce(string_agg(cast(turn as varchar), ',') over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), '') as images from conversations",
)
def steps_image_window(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", F.array_join(S.past_values("turn", K, O, 2).cast("array<string>"), ",").alias("images"))


@register(
    "steps_index",
    "select conv_id, turn, cast(row_number() over (partition by conv_id order by turn) - 1 as bigint) as idx, cast(count(*) over (partition by conv_id) as bigint) as n_steps from conversations",
)
def steps_index(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", S.step_index(K, O).cast("long").alias("idx"), F.count(F.lit(1)).over(S.whole(K, O)).alias("n_steps"))


@register(
    "steps_all_indices",
    "select conv_id, turn, string_agg(cast(turn as varchar), ',') over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) as all_turns from conversations",
)
def steps_all_indices(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", F.array_join(F.collect_list(F.col("turn").cast("string")).over(S.whole(K, O)), ",").alias("all_turns"))


@register(
    "steps_replay_flag",
    "select conv_id, turn, row_number() over (partition by conv_id order by turn) <= count(*) over (partition by conv_id) // 2 as is_replay from conversations",
)
def steps_replay_flag(spark, sf_dir):
    half = F.floor(F.count(F.lit(1)).over(S.whole(K, O)) / 2)
    return conversations(spark, sf_dir).select("conv_id", "turn", S.replay_flag(half, K, O).alias("is_replay"))


DONE = "Finish the task."


@register(
    "steps_terminal",
    f"select conv_id, turn, case when lead(1) over (partition by conv_id order by turn) is null then '{DONE}' else text end as proposal from conversations",
)
def steps_terminal(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", S.terminal_text("text", DONE, K, O).alias("proposal"))


SKIP_SQL = """
with s as (
  select c.conv_id, c.turn, c.text, coalesce(l.toxic, 0) = 1 as skip,
    coalesce(string_agg(nullif(c.text, ''), chr(10)) over (partition by c.conv_id order by c.turn rows between unbounded preceding and 1 preceding), '') as history
  from conversations c left join labels l on l.doc_id = c.conv_id + c.turn
)
"""


def _with_skip(spark, sf_dir):
    rows = conversations(spark, sf_dir).withColumn("doc_id", F.col("conv_id") + F.col("turn"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    marked = rows.join(labels, "doc_id", "left").withColumn("skip", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return marked.withColumn("history", S.history("text", K, O))


@register("steps_skip_flag", SKIP_SQL + "select conv_id, turn, history from s where not skip")
def steps_skip_flag(spark, sf_dir):
    return _with_skip(spark, sf_dir).where("not skip").select("conv_id", "turn", "history")


@register("build_dual_type", SKIP_SQL + "select conv_id, turn, history, t as training_type from s cross join (values ('type1'), ('type2')) v(t) where not skip")
def build_dual_type(spark, sf_dir):
    return S.fan_out(_with_skip(spark, sf_dir).where("not skip").select("conv_id", "turn", "history"))


@register(
    "steps_prev_image",
    """
with s as (select conv_id, turn, row_number() over (partition by conv_id order by turn) <= count(*) over (partition by conv_id) // 2 as replay from conversations)
select conv_id, turn, coalesce(lag(turn) over (partition by conv_id, replay order by turn), case when not replay then max(case when replay then turn end) over (partition by conv_id) end) as prev_image from s
""",
)
def steps_prev_image(spark, sf_dir):
    half = F.floor(F.count(F.lit(1)).over(S.whole(K, O)) / 2)
    rows = conversations(spark, sf_dir).select("conv_id", "turn", S.replay_flag(half, K, O).alias("replay"))
    return rows.select("conv_id", "turn", S.previous_image("turn", "replay", K, O).alias("prev_image"))


@register(
    "build_human",
    """
with r as (select *, row_number() over (partition by conv_id order by turn) as i, lead(1) over (partition by conv_id order by turn) is null as last from conversations)
select conv_id, turn, coalesce(nullif(text, ''), '') as task, last and role = 'user' as done, case when last and role = 'user' then 1.0 else 0.0 end::double as reward,
  case when text is not null then 'images/' || cast(conv_id as varchar) || '_' || cast(turn as varchar) || '.png' end as image from r where i <= 5
""",
)
def build_human(spark, sf_dir):
    rows = conversations(spark, sf_dir).withColumn("last", S.is_last(K, O))
    first = planning.first_n(rows, K, O, 5)
    done = F.col("last") & (F.col("role") == "user")
    image = F.when(F.col("text").isNotNull(), F.concat(F.lit("images/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".png")))
    return first.select("conv_id", "turn", T.first_filled("text").alias("task"), done.alias("done"), F.when(done, 1.0).otherwise(0.0).alias("reward"), image.alias("image"))


@register(
    "build_from_hub",
    """
select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as idx, event_type, coalesce(cast(json_extract(props, '$.k') as bigint), 0) as k
from events where event_type <> 'error'
""",
)
def build_from_hub(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'")
    k = F.coalesce(F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')"), F.lit(0).cast("long"))
    return rows.select("user_id", "event_id", S.step_index(["user_id"], ["ts", "event_id"]).cast("long").alias("idx"), "event_type", k.alias("k"))


@register("build_shuffle")
def build_shuffle(spark, sf_dir):
    """Seeded shuffle: an order that any cluster repeats."""
    return conversations(spark, sf_dir).orderBy(F.xxhash64("conv_id", "turn", F.lit(42)), "conv_id", "turn").select("conv_id", "turn")


@register("build_messages")
def build_messages(spark, sf_dir):
    """Chat messages of each step with history and past images."""
    rows = conversations(spark, sf_dir)
    task = F.first(T.first_filled("text")).over(S.whole(K, O))
    image = F.concat(F.lit("images/"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".png"))
    call = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("computer_use").alias("name"))))
    rows = rows.withColumn("task", task).withColumn("image", image).withColumn("call", call)
    return S.training_messages(rows, K, O, "task", "text", "image", "call").select("conv_id", "turn", F.to_json("messages").alias("messages"))


@register(
    "desc_fallbacks",
    """
with d as (select doc_id, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then null else source end as generated, case when doc_id % 2 = 0 then lang else '' end as new_text from documents)
select doc_id, coalesce(nullif(generated, ''), new_text, '') as truthy, coalesce(new_text, generated, '') as by_key,
  coalesce(nullif(trim(new_text), ''), nullif(trim(generated), ''), 'Unknown task') as first_not_blank from d
""",
)
def desc_fallbacks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.col("source")).alias("generated"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("new_text")
    )
    return d.select("doc_id", F.coalesce(T.filled("generated"), "new_text", F.lit("")).alias("truthy"), F.coalesce("new_text", "generated", F.lit("")).alias("by_key"), T.first_not_blank("new_text", "generated", default="Unknown task").alias("first_not_blank"))


@register(
    "denoise_filter",
    """
select c.conv_id, max(c.turn) as last_turn, arg_max(c.role, c.turn) as last_role from conversations c join labels l on l.doc_id = c.conv_id
where l.quality = 1 group by c.conv_id having arg_max(c.role, c.turn) = 'assistant'
""",
)
def denoise_filter(spark, sf_dir):
    last = conversations(spark, sf_dir).groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return last.where("last_role = 'assistant'").join(good, "conv_id", "left_semi")


@register("denoise_mismatch", "select d.doc_id, l.toxic from documents d left join labels l on l.doc_id = d.doc_id where l.toxic is distinct from 1")
def denoise_mismatch(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return joined.where(~F.col("toxic").eqNullSafe(F.lit(1)))


@register("denoise_unverified", "select d.doc_id from documents d left join labels l on l.doc_id = d.doc_id where l.quality is null")
def denoise_unverified(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.where("quality is null").select("doc_id")


@register(
    "backfill_first_match",
    """
select user_id, coalesce(cast(arg_min(event_id, ts) filter (where event_type = 'purchase') as varchar), 'none') as chosen,
  case when bool_or(event_type = 'purchase') then 'candidate_match' else 'fallback_direct' end as method from events group by user_id
""",
)
def backfill_first_match(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("event_id"), "ts", (F.col("event_type") == "purchase").alias("matched"))
    return planning.first_match(rows, ["user_id"], "matched", ["ts", "event_id"], "event_id", F.lit("none"))


@register("max_branch_flag", "select conv_id, turn, turn = max(turn) over (partition by conv_id) as is_max from conversations")
def max_branch_flag(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", "turn", (F.col("turn") == F.max("turn").over(S.whole(K, O))).alias("is_max"))


@register(
    "repeated_actions",
    """
with c as (select user_id, ts, event_id, event_type, case when lag(event_type) over (partition by user_id order by ts, event_id) is distinct from event_type then 1 else 0 end as new_run from events),
r as (select *, sum(new_run) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from c)
select user_id, cast(run as bigint) as run, event_type, cast(count(*) as bigint) as length from r group by user_id, run, event_type having count(*) >= 3
""",
)
def repeated_actions(spark, sf_dir):
    marked = S.runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "event_type", ["user_id"], ["ts", "event_id"])
    return marked.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("length")).where("length >= 3")


@register(
    "session_by_marker",
    """
with s as (select user_id, event_id, sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from events)
select user_id, cast(session as bigint) as session, cast(count(*) as bigint) as n, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from s group by user_id, session
""",
)
def session_by_marker(spark, sf_dir):
    rows = S.sessions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"])
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("event_id")).cast("array<string>"), ",").alias("ids"))
