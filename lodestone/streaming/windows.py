"""Structured Streaming: windows with watermarks, time-to-live state, idempotent ingest.

The same functions take batch DataFrames where noted, so results can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_event_time(events: DataFrame, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling(events: DataFrame, keys: list[str], size: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums by window; batch or stream."""
    w = F.window(F.col(ts).cast("timestamp") if not events.isStreaming else F.col(ts), size)
    return events.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, keys: list[str], size: str, step: str, ts: str = "ts") -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp") if not events.isStreaming else F.col(ts), size, step)
    return events.groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, keys: list[str], gap: str, ts: str = "ts") -> DataFrame:
    w = F.session_window(F.col(ts).cast("timestamp") if not events.isStreaming else F.col(ts), gap)
    return events.groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def latest_within(events: DataFrame, key: str, ttl_ms: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """A cache as a stream: for each key the latest value of its batch, and whether an unexpired one was there before.

    State is dropped by event time after the time to live, so it is bounded by the keys alive. Rows of ``key``, ts, value; the
    stream needs a watermark on ``ts``.
    """
    out = "key string, value double, ts timestamp, hit boolean"

    def update(names: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = pd.concat(list(frames)).sort_values("ts")
        last = frame.iloc[-1]
        at = int(last["ts"].timestamp() * 1000)
        hit = state.exists and at - state.get[0] <= ttl_ms
        state.update((at,))
        if at + ttl_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(at + ttl_ms)
        yield pd.DataFrame({"key": [names[0]], "value": [last["value"]], "ts": [last["ts"]], "hit": [hit]})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, out, "at long", "update", GroupStateTimeout.EventTimeTimeout)


def cache_stats(entries: DataFrame, as_of, ttl_seconds: int, ts: str = "ts", keys: list[str] = ()) -> DataFrame:
    """total, expired, active at a given time, by the keys."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    return entries.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(age > ttl_seconds).alias("expired"), F.count_if(age <= ttl_seconds).alias("active"))


def ingest_once(stream: DataFrame, keys: list[str], sink: str, checkpoint: str):
    """Append rows whose keys the sink has not got; a batch that is replayed adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates(keys)
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(sink).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def response_cache(answers: DataFrame, keys: list[str], as_of, ttl_seconds: int, ts: str = "ts") -> DataFrame:
    """key (SHA-256 of the asked fields), ts and valid of the latest answer to each question."""
    key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), 256)
    latest = answers.groupBy(key.alias("key")).agg(F.max(ts).alias("ts"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return latest.withColumn("valid", age <= ttl_seconds)
