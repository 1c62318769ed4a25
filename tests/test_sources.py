"""The stored-replies source, caches with timers, quantile sketches."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.sources import replies
from lodestone.streaming import caches, windows


def _drain(stream, checkpoint, out, mode="append"):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "replies"
    for k in range(12):
        kind = root / ("npm" if k % 3 else "pypi") / "deep"
        kind.mkdir(parents=True, exist_ok=True)
        (kind / f"p{k}.json").write_bytes(b'{"k": %d}\xff' % k)
        os.utime(kind / f"p{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    (root / "loose.json").write_text("not below a kind")
    (root / "npm" / "_hidden").write_text("x")
    return root


def test_reads_what_is_stored_and_filters_the_listing(spark, folder, monkeypatch):
    replies.register(spark)
    df = spark.read.format("stored_replies").load(str(folder))
    rows = df.collect()
    assert sorted(r.name for r in rows) == sorted(f"p{k}.json" for k in range(12))
    assert all(r.content == f'{{"k": {r.name[1:-5]}}}�' and r.size == len(r.content) for r in rows)
    some = df.where("kind = 'pypi' and name in ('p3.json', 'p6.json', 'p1.json') and size > 3")
    assert sorted(r.name for r in some.collect()) == ["p3.json", "p6.json"]
    for name in ("p3.json", "p6.json"):
        assert some.where(F.col("name") == name).count() == 1
    reader = replies._Reader(str(folder))
    left = list(reader.pushFilters([replies.EqualTo(("kind",), "npm"), replies.StringStartsWith(("name",), "p1"), replies.EqualTo(("content",), "x")]))
    assert [f.attribute for f in left] == [("content",)]
    assert sorted(f[1] for p in reader.partitions() for f in p.files) == ["p1.json", "p10.json", "p11.json"]
    later = df.where(F.col("modified") >= F.to_timestamp(F.lit(1_700_000_008))).count()
    assert later == 4


def test_partitions_follow_the_bytes(monkeypatch, folder):
    monkeypatch.setattr(replies, "PART_BYTES", 10_000)
    parts = replies._Reader(str(folder)).partitions()
    assert len(parts) == 4 and sum(len(p.files) for p in parts) == 12
    assert replies._Reader(str(folder / "nothing")).partitions()[0].files == []


def test_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    replies.register(spark)
    stream = spark.readStream.format("stored_replies").load(str(folder)).select("name", "content")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    _drain(stream, checkpoint, out)
    assert spark.read.parquet(out).count() == 12
    (folder / "npm" / "new.json").write_text("later")
    _drain(spark.readStream.format("stored_replies").load(str(folder)).select("name", "content"), checkpoint, out)
    assert spark.read.parquet(out).count() == 13 and spark.read.parquet(out).where("name = 'new.json'").count() == 1


def _asked(spark, n, caches_, keys, step_s):
    rng = np.random.default_rng(n)
    rows = [(f"c{rng.integers(caches_)}", f"k{int(rng.integers(keys))}", 1_700_000_000 + k * step_s) for k in range(n)]
    return spark.createDataFrame(rows, "cache string, key string, at long").select("cache", "key", F.timestamp_seconds("at").alias("ts"))


def test_cache_stream_is_the_replay_over_batches_and_a_restart(spark, tmp_path):
    hour = 3_600_000
    options = {"lifetime_ms": 24 * hour, "purge_age_ms": 12 * hour, "limit": 40}
    asked = _asked(spark, 1500, 2, 90, 300)
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    bounds = [1_700_000_000 + 300 * k for k in (0, 400, 800, 1100, 1500)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        asked.where((F.unix_timestamp("ts") >= a) & (F.unix_timestamp("ts") < b)).coalesce(1).write.mode("append").parquet(source)
        stream = windows.with_event_time(spark.readStream.schema(asked.schema).parquet(source), lateness="10 minutes")
        _drain(caches.cached(stream, **options), checkpoint, out)  # each query is a restart from the checkpoint
    show = lambda df: sorted((r.cache, r.key, str(r.ts), r.hit, r.purged) for r in df.collect())
    got, want = show(spark.read.parquet(out)), show(caches.replayed(asked, **options))
    assert got == want
    assert sum(r[4] for r in want) > 0 and 0.1 < sum(r[3] for r in want) / len(want) < 0.9


def test_replay_follows_the_rules(spark):
    hour = 3600
    rows = [("c", "a", 0), ("c", "b", 1 * hour), ("c", "a", 23 * hour), ("c", "a", 25 * hour), ("c", "d", 26 * hour), ("c", None, 27 * hour), (None, "a", 27 * hour), ("c", "d", 28 * hour)]
    asked = spark.createDataFrame(rows, "cache string, key string, at long").select("cache", "key", F.timestamp_seconds("at").alias("ts"))
    got = {(r.cache, r.key, int(r.ts.timestamp()) // hour): (r.hit, r.entries, r.purged) for r in caches.replayed(asked, limit=2).collect()}
    assert got["c", "a", 23] == (True, 2, 0)  # younger than a day
    assert got["c", "a", 25] == (False, 2, 0)  # older: stored anew
    assert got["c", "d", 26] == (False, 2, 0)  # b has expired and makes room
    assert got["c", "", 27][0] is False and got["", "a", 27] == (False, 1, 0) and got["c", "d", 28][0] is True
    assert {r.hit for r in caches.replayed(asked, shards=3).collect()} == {True, False}


def test_sketch_ranks_are_within_their_error(spark):
    frame = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.pow(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double"), 2.0).alias("v")).repartition(7)
    frame = frame.unionByName(spark.createDataFrame([(9, None)], "g long, v double"))
    parts = metrics.quantile_sketches(frame.withColumn("part", F.spark_partition_id()), ["g", "part"], "v")
    merged = metrics.merged_sketches(parts, ["g"])
    assert merged.count() == 3 and merged.select(F.max(F.length("sketch"))).first()[0] < 20_000
    for r in metrics.quantiles(merged, ["g"], (1, 50, 95, 99)).collect():
        own = np.sort(np.array([x.v for x in frame.where(F.col("g") == r.g).select("v").collect()]))
        assert r.n == len(own)
        for p in (1, 50, 95, 99):
            assert abs(np.searchsorted(own, r[f"p{p}"]) / len(own) - p / 100) < 0.01


def test_sketches_of_a_stream_are_those_of_the_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = windows.event_stream(spark, str(tmp_path / "e"), events.schema)
    q = metrics.quantile_sketches(stream, ["event_type"], "value").writeStream.format("memory").queryName("sketches").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = metrics.quantiles(spark.table("sketches"), ["event_type"], (50, 95))
    exact = metrics.nearest_rank(events, ["event_type"], "value", (50, 95))
    for r in got.join(exact.withColumnsRenamed({"p50": "e50", "p95": "e95"}), "event_type").collect():
        own = sorted(x.value for x in events.where(F.col("event_type") == r.event_type).collect())
        for a, b in ((r.p50, r.e50), (r.p95, r.e95)):
            assert abs(own.index(a) - own.index(b)) <= max(2, 0.01 * len(own))
