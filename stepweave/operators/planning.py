"""What is still to be done: catch-up counts, skip lists, unfinished work, and first-seen deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.text import normalized


def catch_up(expected: DataFrame, existing: DataFrame, keys: list[str], wanted: str = "expected") -> DataFrame:
    """expected(keys, wanted) minus the existing rows of each key, where something remains."""
    have = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("existing"))
    plan = expected.join(have, keys, "left").withColumn("existing", F.coalesce("existing", F.lit(0)).cast("long"))
    return plan.withColumn("remaining", F.col(wanted) - F.col("existing")).where("remaining > 0")


def skip_processed(work: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(processed.select(*keys), keys, "left_anti")


def allow_list(work: DataFrame, key: str, wanted: list) -> DataFrame:
    return work.where(F.col(key).isin(wanted))


def last_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    down = [F.desc(c) if isinstance(c, str) else c for c in order]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*down))).where(f"_rank <= {n}").drop("_rank")


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"_rank <= {n}").drop("_rank")


def first_occurrence(df: DataFrame, text: str, order: str) -> DataFrame:
    """Of rows with one normalized text, the first. Aggregation, not a window: copies are combined before the shuffle."""
    return df.groupBy(normalized(text).alias("norm")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_rows"))


def text_digest(text: Column | str) -> Column:
    """128 bits of a text, which are shuffled in its place."""
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("b"), F.reverse(c)).alias("b"))


def not_in_store(df: DataFrame, text: str, store: DataFrame, store_text: str) -> DataFrame:
    """Rows whose normalized text the store lacks (a null one is never there). Texts meet by their digests."""
    known = store.select(text_digest(normalized(store_text)).alias("_digest")).where(F.col(store_text).isNotNull()).distinct()
    return df.withColumn("_digest", text_digest(normalized(text))).join(known, "_digest", "left_anti").drop("_digest")


def check_and_store(proposals: DataFrame, store: DataFrame, text: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(proposals that are new, the store with them): the first of equal texts alone."""
    new = proposals.withColumn("norm", normalized(text)).join(store.select("norm").distinct(), "norm", "left_anti")
    first = new.withColumn("_rank", F.row_number().over(Window.partitionBy("norm").orderBy(order))).where("_rank = 1").drop("_rank")
    return first, store.select("norm").unionByName(first.select("norm"))


def insert_if_absent(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return store.unionByName(rows.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


def append_log_latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The current state of an append-only log: each key's last row."""
    others = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("s")).select(*keys, "s.*")


def first_match(candidates: DataFrame, keys: list[str], matched: str, order: list[str], value: str, fallback: Column) -> DataFrame:
    """The first matched candidate's value and method `candidate_match`, else the fallback and `fallback_direct`."""
    found = F.min_by(F.when(F.col(matched), F.col(value)), F.when(F.col(matched), F.struct(*order)))
    out = candidates.groupBy(*keys).agg(found.alias("found"), F.bool_or(matched).alias("any"))
    return out.select(*keys, F.coalesce("found", fallback).alias("chosen"), F.when(F.col("any"), "candidate_match").otherwise("fallback_direct").alias("method"))
