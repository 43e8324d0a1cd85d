"""Streams of change events: debounced batches, triggers, incremental state.

The functions take and return DataFrames and work on a batch and on a stream alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def debounced(events: DataFrame, gap: str, time: str = "ts", key: str | None = None, late: str | None = None) -> DataFrame:
    """Batches of events with no silence of `gap` in them: start, end (of the last event's
    gap), n and what kinds the batch holds. late: how long a stream waits for stragglers; on a
    stream, Spark asks for a key."""
    if late:
        events = events.withWatermark(time, late)
    if not key and not events.isStreaming:
        return _debounced_at_once(events, gap, time)
    keys = [F.session_window(time, gap).alias("w"), *([F.col(key)] if key else [])]
    kinds = F.array_sort(F.collect_set("event_type"))
    g = events.groupBy(*keys).agg(F.count("*").alias("n"), kinds.alias("kinds"))
    return g.select(*([key] if key else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "kinds")


def _debounced_at_once(events: DataFrame, gap: str, time: str, bucket: str = "1 hour") -> DataFrame:
    """debounced() of a whole table without a key, in many tasks: batches within buckets of time
    first; only the first and the last of each bucket, two rows a bucket, can go on into
    another, and those are put in order and joined."""
    # stored before it is read in part: Spark doesn't merge sessions of which only the start is read
    parts = checkpointed(debounced(events.withColumn("_bucket", F.window(time, bucket)["start"]), gap, time, "_bucket"))
    ends = parts.groupBy("_bucket").agg(F.min("start").alias("_first"), F.max("start").alias("_last"))
    parts = parts.join(ends, "_bucket")
    at_end = (F.col("start") == F.col("_first")) | (F.col("start") == F.col("_last"))
    inner = parts.where(~at_end).select("start", "end", "n", "kinds")
    order = Window.orderBy("start")
    goes_on = (F.lag("_bucket").over(order) != F.col("_bucket")) & (F.lag("end").over(order) >= F.col("start"))
    outer = parts.where(at_end).withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    outer = outer.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds"))))
    joined = outer.groupBy("_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), kinds.alias("kinds"))
    return inner.unionByName(joined.drop("_group"))


def triggers(batches: DataFrame, code: tuple[str, ...]) -> DataFrame:
    """batches with rebuild (a kind of code is in it) and notify (another one is)."""
    known = F.array(*map(F.lit, code))
    return batches.withColumns({"rebuild": F.arrays_overlap("kinds", known), "notify": F.size(F.array_except("kinds", known)) > 0})


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(changes: DataFrame) -> DataFrame:
    """The latest change of each path: path, seen."""
    return changes.groupBy("path").agg(F.max("seen").alias("seen"))


def merge_state(state: DataFrame, batch: DataFrame, keep: float = 0.5) -> DataFrame:
    """State with the batch's slices of files replaced. Raises if more than 1 - keep of the
    rows would go: an empty extraction must not wipe a graph."""
    from ..operators.merging import replace_tiers

    new = checkpointed(replace_tiers(state, batch))
    if new.count() < keep * state.count():
        raise ValueError("the new state would lose too many rows")
    return new
