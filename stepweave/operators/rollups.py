"""Outcome, usage, cost, status and display rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import common_cost

# Macro groups of result domains.
GROUPS = {
    "Office": ["libreoffice_calc", "libreoffice_impress", "libreoffice_writer"],
    "Daily": ["vlc", "thunderbird", "chrome"],
    "Professional": ["gimp", "vs_code"],
}


def macro_group(domain: str, groups: dict[str, list[str]] = GROUPS) -> Column:
    out = F.lit(None).cast("string")
    for name, members in groups.items():
        out = F.when(F.col(domain).isin(members), name).otherwise(out)
    return out


def success_rates(results: DataFrame, group: str, domain: str, score: str) -> DataFrame:
    """Rates by domain, by group and overall from one aggregation; `level` is 0 for domains, 1 for groups, 3 for all."""
    rates = results.rollup(group, domain).agg(F.count(F.lit(1)).alias("n"), (F.avg(score) * 100).alias("rate"), F.grouping_id().alias("level"))
    return rates.withColumn("level", F.col("level").cast("int"))


def guarded_average(score: str) -> Column:
    return F.coalesce(F.avg(score), F.lit(0.0))


def usage(calls: DataFrame, model: str, prompt: str, completion: str, cost: Column) -> DataFrame:
    """Tokens and cost of each model, and of all (model null)."""
    return calls.withColumn("_cost", cost).rollup(model).agg(
        F.sum("_cost").alias("cost"), F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"), F.sum(F.col(prompt) + F.col(completion)).alias("total_tokens")
    )


def token_cost(prompt: Column | str, completion: Column | str, price_in: Column, price_out: Column) -> Column:
    """Prices are for a thousand tokens."""
    p, c = (F.col(x) if isinstance(x, str) else x for x in (prompt, completion))
    return (price_in * p + price_out * c) / 1000


def flatten_operations(logs: DataFrame, operations: str = "operations") -> DataFrame:
    """A row an operation, tagged with its module; a missing time stamp counts as 0."""
    flat = logs.select(*[c for c in logs.columns if c != operations], F.explode(operations).alias("module", "items")).withColumn("op", F.explode("items")).drop("items")
    return flat.withColumn("at", F.coalesce("op.timestamp", F.lit(0.0)))


def display_statistics(ops: DataFrame, file: str) -> DataFrame:
    """ops(file, module, op struct of operation, timestamp, tokens, cost, duration, step_count) -> a row a file.

    Three shapes: a controller that reports a finished main loop gives steps and duration itself; else a fast agent's
    `fast_action_execute` and `fast_planning` operations do; else executions by the hardware are the steps, and all durations add up."""
    op = F.col("op")
    loop = (F.col("module") == "controller") & (op["operation"] == "main_loop_completed")
    fast = op["operation"].isin("fast_action_execute", "fast_planning_execution")
    hardware = (F.col("module") == "hardware")
    first_loop = F.min(F.when(loop, F.struct(F.col("at"), op["step_count"].alias("s"), op["duration"].alias("d"))))
    per = ops.groupBy(file).agg(
        first_loop.alias("loop"),
        F.bool_or(fast).alias("is_fast"),
        F.count_if(fast).alias("fast_steps"),
        F.count_if(hardware).alias("hardware_steps"),
        F.sum(F.when(fast, op["duration"])).alias("fast_duration"),
        F.sum(op["duration"]).alias("all_duration"),
        F.sum(F.coalesce(F.try_element_at(op["tokens"], F.lit(1)), F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce(F.try_element_at(op["tokens"], F.lit(2)), F.lit(0))).alias("output_tokens"),
        F.sum(F.coalesce(F.try_element_at(op["tokens"], F.lit(3)), F.lit(0))).alias("total_tokens"),
        F.sum(common_cost(F.coalesce(op["cost"], F.lit("0￥")))).alias("cost"),
    )
    steps = F.when(F.col("loop").isNotNull(), F.col("loop.s")).when(F.col("is_fast"), F.col("fast_steps")).otherwise(F.col("hardware_steps"))
    duration = F.when(F.col("loop").isNotNull(), F.col("loop.d")).when(F.col("is_fast"), F.col("fast_duration")).otherwise(F.col("all_duration"))
    return per.select(file, steps.cast("long").alias("steps"), F.coalesce(duration, F.lit(0.0)).cast("long").alias("duration"), "input_tokens", "output_tokens", "total_tokens", "cost")


def display_totals(per_file: DataFrame) -> DataFrame:
    """Over files: sums, but the longest duration."""
    sums = [F.sum(c).alias(c) for c in ("steps", "input_tokens", "output_tokens", "total_tokens", "cost")]
    return per_file.agg(F.count(F.lit(1)).alias("files"), *sums, F.max("duration").alias("duration"))


def status_columns(done: Column, error: Column, message_exit: Column, thought_exit: Column, n_steps: Column, max_steps: int) -> tuple[Column, Column]:
    """(full, brief) status of a task. The full view asks done, error, exits, then steps; in the brief one the step limit wins."""
    rest = F.when(error, "Error").when(message_exit, "Done (Message Exit)").when(thought_exit, "Done (Thought Exit)")
    full = F.when(n_steps == 0, "Initializing").when(done, "Done").otherwise(rest.when(n_steps >= max_steps, "Done (Max Steps)").otherwise("Running"))
    brief = F.when(n_steps == 0, "Initializing").when(n_steps >= max_steps, "Done (Max Steps)").when(done, "Done").otherwise(rest.otherwise("Running"))
    return full, brief


def failure_histogram(rows: DataFrame, key: str, order: str, most: int = 10) -> DataFrame:
    """Counts by key in the order in which keys first occur, the first `most`."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at")).orderBy("first_at", key).limit(most)


def since_last(rows: DataFrame, keys: list[str], order: list[str], check: Column) -> DataFrame:
    """How many rows follow each key's last check; all of them without one."""
    last = F.max(F.when(check, F.struct(*order))).over(Window.partitionBy(*keys))
    marked = rows.withColumn("_last", last).withColumn("_after", F.col("_last").isNull() | (F.struct(*order) > F.col("_last")))
    return marked.groupBy(*keys).agg(F.count_if("_after").alias("n"))


def observed(df: DataFrame, **counters: Column):
    """(df, Observation): run statistics gathered while df is written, without another pass."""
    from pyspark.sql import Observation

    watch = Observation()
    return df.observe(watch, *[F.count_if(c).alias(name) for name, c in counters.items()]), watch
