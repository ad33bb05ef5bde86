"""Structured Streaming over event and step tables; each query has a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from stepweave.functions.text import normalized


def file_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(format).load(path)


def new_texts(stream: DataFrame, text: str, ts: str | None = None, late: str = "1 hour") -> DataFrame:
    """Global first-seen deduplication. With a time column the state is dropped after the watermark; without, it is for ever."""
    keyed = stream.withColumn("norm", normalized(text))
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["norm"]) if ts else keyed.dropDuplicates(["norm"])


def tumbling(events: DataFrame, ts: str, length: str, late: str, *keys: str) -> DataFrame:
    return _windows(events.withWatermark(ts, late) if events.isStreaming else events, F.window(ts, length), keys)


def sliding(events: DataFrame, ts: str, length: str, step: str, late: str, *keys: str) -> DataFrame:
    return _windows(events.withWatermark(ts, late) if events.isStreaming else events, F.window(ts, length, step), keys)


def session_counts(events: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    return _windows(events.withWatermark(ts, late) if events.isStreaming else events, F.session_window(ts, gap), keys)


def _windows(events: DataFrame, window, keys) -> DataFrame:
    counts = events.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "mean_value")


STATUS = "user_id long, n long, last_ts timestamp, last_type string, status string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts steps and keeps the latest one; a finished task is frozen once its state has timed out."""
    if state.hasTimedOut:
        n, last_ts, last_type = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ts": [pd.Timestamp(last_ts, unit="us")], "last_type": [last_type], "status": ["Frozen"]})
        return
    n, last_ts, last_type = state.get if state.exists else (0, -1, "")
    for pdf in batches:
        n += len(pdf)
        newest = pdf.sort_values(["ts", "event_id"]).iloc[-1]
        micros = int(newest["ts"].value // 1000)
        if micros >= last_ts:
            last_ts, last_type = micros, newest["event_type"]
    state.update((n, last_ts, last_type))
    status = {"purchase": "Done", "error": "Error"}.get(last_type, "Running")
    if status == "Done":
        state.setTimeoutTimestamp(max(last_ts // 1000 + 30_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ts": [pd.Timestamp(last_ts, unit="us")], "last_type": [last_type], "status": [status]})


def status_updates(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A row for each task that a batch changes; Done is re-checked for 30 seconds of event time, then frozen and dropped from the state."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(_advance, STATUS, "n long, last_ts long, last_type string", "update", GroupStateTimeout.EventTimeTimeout)


def rule_triggers(events: DataFrame, repeated: int = 3, checks: str = "signup", commands: int = 5) -> DataFrame:
    """Per task and batch: a run of equal actions that reaches `repeated`, and `commands` actions since the last check."""

    def run(key, batches, state):
        run_type, length, since = state.get if state.exists else ("", 0, 0)
        found = []
        for pdf in batches:
            for row in pdf.sort_values(["ts", "event_id"]).itertuples():
                length = length + 1 if row.event_type == run_type else 1
                run_type = row.event_type
                since = 0 if row.event_type == checks else since + 1
                if length == repeated:
                    found.append((key[0], row.event_id, "repeated_action"))
                if since and since % commands == 0:
                    found.append((key[0], row.event_id, "check_due"))
        state.update((run_type, length, since))
        yield pd.DataFrame(found, columns=["user_id", "event_id", "rule"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, rule string", "run_type string, length long, since long", "append", GroupStateTimeout.NoTimeout)


def with_lookup(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream-static join: the table is read anew for each batch."""
    return events.join(table, key, "left")


def poll(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Micro-batches of what is new; done work is in the checkpoint, so a restart repeats none. every=None: until nothing is left."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_sink(stream: DataFrame, path: str, checkpoint: str, format: str = "json", every: str | None = None):
    """An append-only log."""
    writer = stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(stream: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives until nothing is left, as a table under path (batch, row columns)."""
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/rows")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/rows")
