"""Outcome, usage, cost and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepweave.functions import text as T
from stepweave.operators import planning, rollups
from stepweave.plans.registry import register
from stepweave.session import table


@register(
    "success_by_domain",
    """
select c_mktsegment as domain, n_regionkey as grp, cast(count(*) as bigint) as n, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) * 100, 6) as rate
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by rollup (n_regionkey, c_mktsegment)
""",
)
def success_by_domain(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("grp"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("domain"), "c_nationkey").join(nation, "c_nationkey")
    results = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("score")).join(customers, "o_custkey")
    return rollups.success_rates(results, "grp", "domain", "score").select("domain", "grp", "n", F.round("rate", 6).alias("rate"))


@register(
    "success_macro_groups",
    """
select case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'Heavy' when c_mktsegment in ('HOUSEHOLD', 'FURNITURE') then 'Home' end as grp, cast(count(*) as bigint) as n,
  round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) * 100, 6) as rate from orders join customer on c_custkey = o_custkey group by 1
""",
)
def success_macro_groups(spark, sf_dir):
    groups = {"Heavy": ["BUILDING", "MACHINERY"], "Home": ["HOUSEHOLD", "FURNITURE"]}
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), rollups.macro_group("c_mktsegment", groups).alias("grp"))
    joined = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").join(customers, "o_custkey")
    return joined.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)) * 100, 6).alias("rate"))


@register("avg_score_guarded", "select n_nationkey, round(coalesce(avg(c_acctbal), 0), 6) as score from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by n_nationkey")
def avg_score_guarded(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    rows = table(spark, sf_dir, "nation").select("n_nationkey").join(rich, "n_nationkey", "left")
    return rows.groupBy("n_nationkey").agg(F.round(rollups.guarded_average("c_acctbal"), 6).alias("score"))


@register("failure_top", "select event_type, cast(count(*) as bigint) as n, min(event_id) as first_at from events group by event_type order by first_at limit 10")
def failure_top(spark, sf_dir):
    return rollups.failure_histogram(table(spark, sf_dir, "events"), "event_type", "event_id")


@register("failure_samples", "select event_type, event_id from (select *, row_number() over (partition by event_type order by event_id) as r from events) where r <= 25")
def failure_samples(spark, sf_dir):
    return planning.first_n(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 25)


@register(
    "usage_rollup",
    """
with t as (select lang, n_chars // 4 as p, n_chars // 16 as c, case lang when 'en' then 0.01 when 'de' then 0.02 else 0.03 end as price from documents)
select lang, round(sum((price * p + 2 * price * c) / 1000), 6) as cost, cast(sum(p) as bigint) as prompt_tokens, cast(sum(c) as bigint) as completion_tokens, cast(sum(p + c) as bigint) as total_tokens from t group by rollup (lang)
""",
)
def usage_rollup(spark, sf_dir):
    prices = spark.createDataFrame([("en", 0.01), ("de", 0.02)], "lang string, price double")
    calls = table(spark, sf_dir, "documents").select("lang", F.floor(F.col("n_chars") / 4).alias("p"), F.floor(F.col("n_chars") / 16).alias("c")).join(F.broadcast(prices), "lang", "left")
    calls = calls.withColumn("price", F.coalesce("price", F.lit(0.03)))
    return rollups.usage(calls, "lang", "p", "c", rollups.token_cost("p", "c", F.col("price"), 2 * F.col("price"))).withColumn("cost", F.round("cost", 6))


@register(
    "display_rollup",
    """
with f as (select user_id, count(*) as steps, cast(sum(value) as bigint) as duration, sum(coalesce(cast(json_extract(props, '$.k') as bigint), 0)) as tokens from events group by user_id)
select cast(count(*) as bigint) as files, cast(sum(steps) as bigint) as steps, cast(sum(tokens) as bigint) as input_tokens, cast(max(duration) as bigint) as duration from f
""",
)
def display_rollup(spark, sf_dir):
    k = F.coalesce(F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')"), F.lit(0))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum("value")).cast("long").alias("duration"), F.sum(k).alias("input_tokens"))
    per = per.withColumn("output_tokens", F.lit(0)).withColumn("total_tokens", F.lit(0)).withColumn("cost", F.lit(0.0))
    return rollups.display_totals(per).select("files", "steps", "input_tokens", "duration")


LOGS = [
    ("a", {"controller": [("main_loop_completed", 9.0, None, None, 33.0, 7)], "worker": [("plan", 1.0, [10, 5, 15], "0.002$", 2.0, None), ("act", 2.0, [20, 6, 26], "0.01￥", 3.0, None)]}),
    ("b", {"agent": [("fast_action_execute", 1.0, [5, 1, 6], "0.1", 1.5, None), ("fast_action_execute", None, None, None, 2.5, None)]}),
    ("c", {"hardware": [("click", 3.0, None, None, 0.5, None)], "manager": [("plan", 1.0, [7, 7, 14], "1.5€", 4.0, None)]}),
]
LOG_SCHEMA = "file string, operations map<string,array<struct<operation:string,timestamp:double,tokens:array<int>,cost:string,duration:double,step_count:int>>>"


@register("display_statistics", "select * from (values ('a', 7, 33, 30, 11, 41, 0.0244), ('b', 2, 4, 5, 1, 6, 0.1), ('c', 1, 4, 7, 7, 14, 11.7)) v(file, steps, duration, input_tokens, output_tokens, total_tokens, cost)".replace("select *", "select file, cast(steps as bigint) as steps, cast(duration as bigint) as duration, cast(input_tokens as bigint) as input_tokens, cast(output_tokens as bigint) as output_tokens, cast(total_tokens as bigint) as total_tokens, cast(cost as double) as cost"))
def display_statistics(spark, sf_dir):
    logs = spark.createDataFrame(LOGS, LOG_SCHEMA)
    return rollups.display_statistics(rollups.flatten_operations(logs), "file").withColumn("cost", F.round("cost", 6))


COSTS = [(1, "0.000343￥"), (2, "1.5$"), (3, "2€"), (4, "0.25"), (5, "free"), (6, "3.0£ per run")]
COST_ROWS = ", ".join(f"({i}, '{c}')" for i, c in COSTS)


@register(
    "cost_parse",
    f"""
with c(id, t) as (values {COST_ROWS}), p as (select id, coalesce(try_cast(nullif(regexp_extract(t, '([0-9.]+)', 1), '') as double), 0) as v, coalesce(nullif(regexp_extract(t, '[0-9.]+([￥$€£¥]+)', 1), ''), '￥') as s from c)
select id, v as value, s as sign, round(v * case s when '$' then 7.2 when '€' then 7.8 when '£' then 9.1 else 1.0 end, 6) as common from p
""",
)
def cost_parse(spark, sf_dir):
    rows = spark.createDataFrame(COSTS, "id int, t string")
    return rows.select("id", T.cost_value("t").alias("value"), T.cost_sign("t").alias("sign"), F.round(T.common_cost("t"), 6).alias("common"))


STATUS_SQL = """
with s as (select user_id, count(*) as n, arg_max(event_type, (ts, event_id)) = 'purchase' as done, arg_max(event_type, (ts, event_id)) = 'error' as error, bool_or(event_type = 'signup') as message_exit, false as thought_exit from events group by user_id)
"""


def _status(spark, sf_dir):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (last == "purchase").alias("done"), (last == "error").alias("error"), F.bool_or(F.col("event_type") == "signup").alias("message_exit"))
    full, brief = rollups.status_columns(F.col("done"), F.col("error"), F.col("message_exit"), F.lit(False), F.col("n"), 70)
    return per.withColumn("full", full).withColumn("brief", brief)


@register(
    "status_full",
    STATUS_SQL + "select user_id, cast(n as bigint) as progress, case when done then 'Done' when error then 'Error' when message_exit then 'Done (Message Exit)' when thought_exit then 'Done (Thought Exit)' when n >= 70 then 'Done (Max Steps)' else 'Running' end as status from s",
)
def status_full(spark, sf_dir):
    return _status(spark, sf_dir).select("user_id", F.col("n").alias("progress"), F.col("full").alias("status"))


@register(
    "status_brief",
    STATUS_SQL + "select user_id, case when n >= 70 then 'Done (Max Steps)' when done then 'Done' when error then 'Error' when message_exit then 'Done (Message Exit)' when thought_exit then 'Done (Thought Exit)' else 'Running' end as status from s",
)
def status_brief(spark, sf_dir):
    return _status(spark, sf_dir).select("user_id", F.col("brief").alias("status"))


@register(
    "since_last_check",
    """
with l as (select user_id, max((ts, event_id)) filter (where event_type = 'signup') as last from events group by user_id)
select e.user_id, cast(count(*) filter (where l.last is null or (e.ts, e.event_id) > l.last) as bigint) as n from events e join l on l.user_id = e.user_id group by e.user_id
""",
)
def since_last_check(spark, sf_dir):
    return rollups.since_last(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")


@register("latest_state", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def latest_state(spark, sf_dir):
    return planning.append_log_latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@register(
    "config_join",
    "select o.o_orderkey, c.c_name, n.n_name from orders o left join customer c on c.c_custkey = o.o_custkey left join nation n on n.n_nationkey = c.c_nationkey",
)
def config_join(spark, sf_dir):
    """Point lookups as left joins; lookup maps of a fixed size are broadcast by Catalyst's own size check."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left").join(nations, "n_nationkey", "left").select("o_orderkey", "c_name", "n_name")


@register(
    "model_space_map",
    "select doc_id, case source when 'src0' then 'pyautogui' when 'src1' then 'claude_computer_use' else 'computer_13' end as action_space from documents",
)
def model_space_map(spark, sf_dir):
    spaces = F.create_map(*[F.lit(x) for x in ("src0", "pyautogui", "src1", "claude_computer_use")])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(spaces, F.col("source")), F.lit("computer_13")).alias("action_space"))


@register(
    "run_summary",
    "select cast(count(*) as bigint) as processed, cast(count(*) filter (where quality = 1) as bigint) as updated, cast(count(*) filter (where toxic = 1) as bigint) as skipped from labels",
)
def run_summary(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("quality") == 1).alias("updated"), F.count_if(F.col("toxic") == 1).alias("skipped"))
