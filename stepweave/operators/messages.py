"""Message transforms over tables of (conversation, order, role, text): each is a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stepweave.functions.rules import config_filter
from stepweave.functions.text import col, truncated


def white_space_tokens(text: Column | str) -> Column:
    """The default tokenizer: runs of what is not blank. Another can be put in its place wherever a Column is taken."""
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda t: t != "")).cast("long")


def tokens_by(count: Callable[[str], int]):
    """A Column function that counts with a tokenizer of its own, such as a BPE encoder."""

    @F.pandas_udf(LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else count(t)).astype("int64")

    return counted


def tokens_left(tokens: Column | str, limit: int) -> Column:
    return F.lit(limit) - col(tokens)


def share_used(tokens: Column | str, limit: int) -> Column:
    return col(tokens) / F.lit(limit)


def _ranks(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """_old from 1 for the oldest, _new from 1 for the newest."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_old", F.row_number().over(w.orderBy(order))).withColumn("_new", F.row_number().over(w.orderBy(F.desc(order))))


def limit_messages(df: DataFrame, keys: list[str], order: str, most: int, keep_first: bool = False, role: str = "role", compat: bool = False) -> DataFrame:
    """The newest `most` messages in order, the first among them if asked for; an answer of a tool is not kept without what it
    answers, so a tool message in the oldest kept place goes. `place`: order of the result. compat: without keep_first
    the oldest kept message stands second."""
    ranked = _ranks(df, keys, order)
    first = (F.col("_old") == 1) if keep_first else F.lit(False)
    tail = most - 1 if keep_first else most
    edge = (F.col("_new") == tail) & (F.col(role) == "tool") & ~first
    kept = ranked.where((first | (F.col("_new") <= tail)) & ~edge)
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    if compat and not keep_first:
        swapped = F.when(F.col("_new") == most, 2).when((F.col("_new") == most - 1) & (F.max("_new").over(Window.partitionBy(*keys)) == most), 1).otherwise(F.col("place"))
        placed = placed.withColumn("place", swapped.cast("long"))
    return placed.drop("_old", "_new")


def cut_tokens(df: DataFrame, keys: list[str], order: str, tokens: Column, most: int, each: int) -> DataFrame:
    """Newest first, each message cut to `each` tokens, until the budget is used up: the message at the edge is cut to
    what is left, older ones go. One window, no loop."""
    own = df.withColumn("_tokens", F.least(tokens, F.lit(each)))
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    used = F.coalesce(F.sum("_tokens").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("_used", used).withColumn("_over", (F.col("_used") + each > most).cast("int"))
    own = own.withColumn("_edge", F.sum("_over").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.when(F.col("_edge") == 0, F.col("_tokens")).when((F.col("_edge") == 1) & (F.col("_over") == 1), F.least("_tokens", F.lit(most) - F.col("_used")))
    return own.withColumn("kept_tokens", kept.cast("long")).where("kept_tokens is not null and kept_tokens >= 0").drop("_tokens", "_used", "_over", "_edge")


def keep_recent_images(df: DataFrame, keys: list[str], order: list[str], keep: int, step: int) -> DataFrame:
    """Rows are images. All but the newest `keep` may go, oldest first, in multiples of `step`."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_old", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count(F.lit(1)).over(w))
    gone = F.greatest(F.lit(0), F.col("_all") - keep)
    return ranked.where(F.col("_old") > gone - gone % step).drop("_old", "_all")


def cache_breakpoints(df: DataFrame, keys: list[str], order: str, n: int = 3, role: str = "role", user: str = "user") -> DataFrame:
    """Marks each conversation's newest n user turns."""
    rank = F.row_number().over(Window.partitionBy(*keys, role).orderBy(F.desc(order)))
    return df.withColumn("breakpoint", (F.col(role) == user) & (rank <= n))


def filter_messages(df: DataFrame, rules: dict[str, list], exclude: bool = False, arrays: tuple[str, ...] = ()) -> DataFrame:
    return df.where(config_filter(rules, exclude, arrays))


def transform_where(df: DataFrame, rules: dict[str, list], column: str, change: Column, exclude: bool = False) -> DataFrame:
    """The column changes in rows that pass the filter alone."""
    return df.withColumn(column, F.when(config_filter(rules, exclude), change).otherwise(F.col(column)))


def compress(df: DataFrame, text: str, cache: DataFrame, compressor, key: str = "content") -> tuple[DataFrame, DataFrame]:
    """Texts through a compressor (Column -> Column), once for each distinct text that the cache lacks. -> (rows, cache)."""
    own = df.withColumn(key, F.sha2(F.col(text), 256))
    misses = own.groupBy(key).agg(F.first(text).alias("_text")).join(cache, key, "left_anti")
    grown = cache.unionByName(misses.select(key, compressor(F.col("_text")).alias("compressed")))
    return own.join(grown, key, "left").withColumn(text, F.coalesce("compressed", text)).drop(key, "compressed"), grown


def digest(df: DataFrame, keys: list[str], order: str, text: str, n: int = 200) -> DataFrame:
    """The texts of a conversation, each cut to n characters, on lines in order."""
    line = F.struct(F.col(order).alias("o"), truncated(text, n).alias("t"))
    return df.where(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("digest"))


def first_passing(candidates: DataFrame, keys: list[str], priority: str, passes: Column) -> DataFrame:
    """Each key's answer of least priority number that passes."""
    others = [c for c in candidates.columns if c not in keys]
    return candidates.where(passes).groupBy(*keys).agg(F.min_by(F.struct(*others), priority).alias("s")).select(*keys, "s.*")
