"""Streams against the same functions on batches."""

from pyspark.sql import functions as F

from lodestone.streaming import windows


def _drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.sql(f"SELECT * FROM {name}")


def test_tumbling_stream_is_the_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = windows.with_event_time(windows.event_stream(spark, str(tmp_path / "e"), events.schema), lateness="60 days")
    got = _drain(windows.tumbling(stream, ["event_type"], "1 day"), "tumbling", "complete")
    want = windows.tumbling(events, ["event_type"], "1 day")
    assert {(r.start, r.event_type, r.n) for r in got.collect()} == {(r.start, r.event_type, r.n) for r in want.collect()}


def test_ingest_once(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "name string, version string")
    for k, part in enumerate((rows, rows.union(spark.createDataFrame([("c", "1")], rows.schema)))):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        q = windows.ingest_once(stream, ["name", "version"], sink, str(tmp_path / f"c{k}"))
        q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [("a", "1"), ("b", "1"), ("c", "1")]


def test_cache_with_time_to_live(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").where("user_id < 5").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = windows.with_event_time(windows.event_stream(spark, str(tmp_path / "e"), events.schema), lateness="60 days")
    got = _drain(windows.latest_within(stream, "user_id", 86_400_000), "cache", "update").collect()
    assert {r.key for r in got} == {str(r[0]) for r in events.select("user_id").distinct().collect()}
