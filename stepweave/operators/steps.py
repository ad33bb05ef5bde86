"""Step tables of trajectories: histories, windows, flags and the examples built from them.

A window is partitioned by trajectory, so no shuffle is larger than the step table, and windows of one partitioning and order
share one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import filled


def before(keys: list[str], order: list[str], n: int | None = None):
    """All rows before the current one, or the n before it."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def along(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def whole(keys: list[str], order: list[str]):
    return along(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def history(text: str, keys: list[str], order: list[str], n: int | None = None, divider: str = "\n") -> Column:
    """Earlier texts that are not empty, joined."""
    return F.array_join(F.collect_list(filled(text)).over(before(keys, order, n)), divider)


def labelled_history(text: str, number: Column, keys: list[str], order: list[str], n: int | None, none: str = "None") -> Column:
    """`Step i reasoning: ...` lines of the n steps before; `none` for the first step. n None: all steps."""
    line = F.concat(F.lit("Step "), number.cast("string"), F.lit(" reasoning: "), F.coalesce(F.col(text), F.lit("")))
    return F.coalesce(filled(F.array_join(F.collect_list(line).over(before(keys, order, n)), "\n")), F.lit(none))


def past_values(value: str, keys: list[str], order: list[str], n: int) -> Column:
    return F.collect_list(value).over(before(keys, order, n))


def step_index(keys: list[str], order: list[str]) -> Column:
    return F.row_number().over(along(keys, order)) - 1


def is_last(keys: list[str], order: list[str]) -> Column:
    """Whether no row follows: from the window of the step order, so one sort serves it too."""
    return F.lead(F.lit(1)).over(along(keys, order)).isNull()


def replay_flag(n_replay: Column, keys: list[str], order: list[str]) -> Column:
    return F.row_number().over(along(keys, order)) <= n_replay


def terminal_text(text: str, constant: str, keys: list[str], order: list[str]) -> Column:
    return F.when(is_last(keys, order), constant).otherwise(F.col(text))


def skipped(is_replay: Column, method: Column, keep: str = "candidate_match") -> Column:
    """Replayed steps whose reasoning was filled in by another method are context alone."""
    return is_replay & method.isNotNull() & (method != keep)


def previous_image(image: str, segment: str, keys: list[str], order: list[str]) -> Column:
    """The image before a step in its segment; the first live step takes the last replayed one."""
    own = F.lag(image).over(along([*keys, segment], order))
    return F.coalesce(own, F.when(~F.col(segment), F.last(F.when(F.col(segment), F.col(image)), ignorenulls=True).over(whole(keys, order))))


def with_both_images(steps: DataFrame, images: DataFrame, keys: list[str], step: str, image: str) -> DataFrame:
    """Steps whose own image and the one before both exist, with both. images(keys, step, image)."""
    after = images.select(*keys, F.col(step), F.col(image).alias("image_after"))
    before_it = images.select(*keys, (F.col(step) + 1).alias(step), F.col(image).alias("image_before"))
    return steps.join(after, [*keys, step]).join(before_it, [*keys, step])


def fan_out(df: DataFrame, kinds: tuple[str, ...] = ("type1", "type2")) -> DataFrame:
    return df.withColumn("training_type", F.explode(F.array(*[F.lit(k) for k in kinds])))


def max_branch_only(df: DataFrame, task: str, branch: str, domain: str, domains: list[str]) -> DataFrame:
    """In the named domains (none by default) only each task's furthest branch stays."""
    if not domains:
        return df
    top = F.max(branch).over(Window.partitionBy(task))
    return df.where(~F.col(domain).isin(domains) | (F.col(branch) == top))


def uniform_sample(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Every (count div most)-th row, then the first `most`: the tail goes unless the count is a multiple."""
    number, count = F.row_number().over(along(keys, order)), F.count(F.lit(1)).over(whole(keys, order))
    stride = F.greatest(F.lit(1), F.floor(count / most)).cast("int")
    picked = df.withColumn("_n", number - 1).withColumn("_stride", F.when(count > most, stride).otherwise(F.lit(1)))
    return picked.where("_n % _stride = 0").where(F.col("_n") / F.col("_stride") < most).drop("_n", "_stride")


def runs(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Gaps and islands: run (a number for each run of equal values) and at (place in the run, from 1)."""
    w = along(keys, order)
    new = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("int")
    marked = df.withColumn("run", F.sum(new).over(w).cast("long"))
    return marked.withColumn("at", F.row_number().over(along([*keys, "run"], order)).cast("long"))


def sessions(df: DataFrame, starts: Column, keys: list[str], order: list[str]) -> DataFrame:
    """A session begins at each row that starts one; rows before the first are session 0."""
    return df.withColumn("session", F.sum(starts.cast("int")).over(along(keys, order)).cast("long"))


def image_labels(text: str, label: str, image: str) -> Column:
    """A text block, then a label block and an image block for each pair of an array of (label, image)."""
    block = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.alias("text"), u.alias("url"))
    none = F.lit(None).cast("string")
    pairs = F.flatten(F.transform(F.arrays_zip(label, image), lambda p: F.array(block("text", p[label], none), block("image_url", none, p[image]))))
    return F.concat(F.array(block("text", F.col(text), none)), pairs)


def training_messages(steps: DataFrame, keys: list[str], order: list[str], task: str, reasoning: str, image: str, call: str, past: int = 2, history_steps: int | None = 10) -> DataFrame:
    """Each step's messages: the system's, a user turn with task, text history and past images, and the assistant's answer.

    The instruction is in every user turn, whether or not there is history. The past images are references; join the bytes last."""
    number = F.row_number().over(along(keys, order))
    text = labelled_history(reasoning, number, keys, order, history_steps)
    images = past_values(image, keys, order, past)
    made = steps.withColumn("_history", text).withColumn("_images", F.concat(images, F.array(F.col(image))))
    none = F.lit(None).cast("string")
    block = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.alias("text"), u.alias("url"))
    asked = F.concat(F.lit("Instruction: "), F.col(task), F.lit("\nPrevious steps:\n"), F.col("_history"))
    user = F.concat(F.array(block("text", asked, none)), F.transform("_images", lambda u: block("image_url", none, u)))
    answer = F.concat(F.coalesce(F.col(reasoning), F.lit("")), F.when(F.col(call).isNotNull(), F.concat(F.lit("\n<tool_call>\n"), F.col(call), F.lit("\n</tool_call>"))).otherwise(""))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    made = made.withColumn("messages", F.array(message("user", user), message("assistant", F.array(block("text", answer, none)))))
    return made.drop("_history", "_images")


def appended(replayed: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Replayed steps and then the new ones: `segment` 0 or 1, and `at` from 0 in each trajectory."""
    rows = replayed.withColumn("segment", F.lit(0)).unionByName(new.withColumn("segment", F.lit(1)))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("segment", order)) - 1)


def chosen_files(files: DataFrame, at: str, gives: list[int]) -> DataFrame:
    """The files whose places are asked for."""
    return files.where(F.col(at).isin(gives))
