"""What the operators share: the folder that every executor sees, and written tables that cut lineage."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none and all tasks run in this process (tests), a folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stepweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of df, from Parquet in the shared folder: nothing upstream runs again, and a lost executor loses none."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: others, whatever their names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def give_back() -> None:
    """Returns freed memory of this process to the system: allocators keep it otherwise, and a driver that runs stage after stage keeps the sum."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def clear_names(columns: list[str], taken: list[str]) -> list[str]:
    """columns, each that has a name of `taken` (whatever its case) with as many `_` at its end as make it new."""
    used, out = {c.lower() for c in [*columns, *taken]}, []
    for c in columns:
        if c.lower() in {t.lower() for t in taken}:
            while c.lower() in used:
                c += "_"
            used.add(c.lower())
        out.append(c)
    return out


def join_hot(rows: DataFrame, found: DataFrame, key: str, share: int = 10_000) -> DataFrame:
    """rows joined (inner) with found, which has one row a key, so that no task gets all rows of a key that very many rows have.

    Keys with 1 / share of all rows or more are fewer than share + 1, so their rows of found are broadcast; all others meet by a
    shuffle, where none has more than that part of the rows. rows is read three times: give it as a written table."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least = max(2, -(-rows.count() // share))
    hot = found.join(counts.where(F.col("_n") >= least).select(key), key, "left_semi")
    named = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    many = named.where("_hot is not null").drop("_hot").join(F.broadcast(hot), key)
    return many.unionByName(named.where("_hot is null").drop("_hot").join(found, key))
