"""Sheet operations on tables: a sheet is a DataFrame, or cells of (sheet, row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.sources.places import work_dir, written

#: Columns that a transposed sheet may have.
WIDEST = 10_000
_AGGREGATES = {"count": F.count, "sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}


def column_sort(df: DataFrame, column: str, ascending: bool = True, ties: str | None = None) -> DataFrame:
    """By the column as numbers. One value that is no number makes the sort fail, as a whole."""
    number = F.col(column).try_cast("double")
    broken = df.where(F.col(column).isNotNull() & number.isNull()).limit(1).count()
    if broken:
        raise ValueError(f"{column} holds values that are no numbers")
    return df.orderBy(number.asc() if ascending else number.desc(), *([ties] if ties else []))


def pivot(df: DataFrame, rows: list[str], columns: str, values: list, measure: str, how: str) -> DataFrame:
    return df.groupBy(*rows).pivot(columns, values).agg(_AGGREGATES[how](measure))


def hide_rows(df: DataFrame, value) -> DataFrame:
    """Rows in which no cell has the value, as text."""
    found = F.lit(False)
    for c in df.columns:
        found = found | F.coalesce(F.col(f"`{c}`").cast("string") == F.lit(str(value)), F.lit(False))
    return df.where(~found)


def violations(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def reorder(df: DataFrame, order: list[str]) -> DataFrame:
    return df.select(*order, *[c for c in df.columns if c not in order])


def transpose(df: DataFrame, key: str) -> DataFrame:
    """Names of the other columns become rows, values of the key become columns: WIDEST of them at most, as a plan has to name them."""
    others = [c for c in df.columns if c != key]
    long = df.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("string").alias(c) for c in others]).unpivot([key], others, "field", "value")
    keys = [r[0] for r in df.select(F.col(key).cast("string").alias(key)).distinct().orderBy(key).limit(WIDEST + 1).collect()]
    if len(keys) > WIDEST:
        raise ValueError(f"{key} has more than {WIDEST} values: a sheet so wide can't be transposed")
    return long.groupBy("field").pivot(key, keys).agg(F.first("value"))


def widths(df: DataFrame) -> DataFrame:
    """(column, width): the longest value or name."""
    longest = df.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in df.columns])
    long = longest.unpivot([], df.columns, "column", "longest")
    return long.select("column", F.greatest("longest", F.length("column")).cast("long").alias("width"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 by the order, without bringing them into one task: ranges of the order, and the rows before each."""
    ordered = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()), work_dir(df.sparkSession, "numbered"))
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    parts = parts.select("_part", (before - F.col("_first")).alias("_shift"))
    return ordered.join(F.broadcast(parts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def cells(df: DataFrame, sheet: str, order: str) -> DataFrame:
    """(sheet, row, col, value), rows numbered by the order."""
    pairs = [F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(df.columns)]
    rows = numbered(df, order, "_row")
    return rows.select(F.lit(sheet).alias("sheet"), F.col("_row").alias("row"), F.explode(F.array(*pairs)).alias("c")).select("sheet", "row", "c.col", "c.value")


def set_column(df: DataFrame, order: str, column: str, values: DataFrame) -> DataFrame:
    """The column takes values(at, value) by place, from 0; places without one keep theirs."""
    joined = numbered(df, order, "at").join(values, "at", "left").withColumn(column, F.coalesce(F.col("value").cast(dict(df.dtypes)[column]), F.col(column)))
    return joined.select(*df.columns)


def last_row(df: DataFrame, order: Column) -> DataFrame:
    """The last row, as strings."""
    return df.orderBy(order.desc()).limit(1).select(*[F.col(c).cast("string").alias(c) for c in df.columns])
