"""Caches as streams: entries with a lifetime, and a purge by size and age, in state that survives restarts.

A row asks a cache for a key at a time. If the cache holds the key and it is younger than the lifetime the row is a hit; else it is a miss and the
entry is stored anew. When a cache has more than ``limit`` live entries, those older than ``purge_age`` go. Timers remove what has expired
while nothing asks for it. Timers only remove what could be no hit and counts no more, so the result is that of ``replayed``, the
same rules over a finished table, whatever the micro-batches are, as long as rows come in order of time.

A cache's entries are one map in the state store (RocksDB), of which a task reads the keys it is asked for; only a purge walks through it. ``shards`` deals a large
cache's keys, and its limit, over several maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIFETIME_MS, PURGE_AGE_MS, LIMIT = 24 * 3_600_000, 12 * 3_600_000, 1000  # fixed values: of the embedding cache
_OUT = "cache string, key string, ts timestamp, hit boolean, entries long, purged long"


class _Entries:
    """The rules, over any map from key to time."""

    def __init__(self, entries, size: int, lifetime: int, purge_age: int, limit: int):
        self.entries, self.size, self.lifetime, self.purge_age, self.limit = entries, size, lifetime, purge_age, limit

    def _drop(self, before: int) -> int:
        old = [k for k, at in self.entries.items() if at <= before]
        for k in old:
            self.entries.remove(k)
        self.size -= len(old)
        return len(old)

    def expire(self, now: int) -> None:
        self._drop(now - self.lifetime)

    def ask(self, key: str, now: int) -> tuple[bool, int]:
        """(hit, purged)"""
        at = self.entries.get(key)
        if at is not None and now - at < self.lifetime:
            return True, 0
        self.entries.put(key, now)
        self.size += at is None
        if self.size > self.limit:
            self.expire(now)
        return False, self._drop(now - self.purge_age - 1) if self.size > self.limit else 0


class _Map:
    """The state store's map of one cache."""

    def __init__(self, state):
        self.state = state

    def get(self, key: str) -> int | None:
        return self.state.getValue((key,))[0] if self.state.containsKey((key,)) else None

    def put(self, key: str, at: int) -> None:
        self.state.updateValue((key,), (at,))

    def remove(self, key: str) -> None:
        self.state.removeKey((key,))

    def items(self) -> list[tuple[str, int]]:
        return [(k[0], v[0]) for k, v in self.state.iterator()]


class _Dict(dict):
    def put(self, key: str, at: int) -> None:
        self[key] = at

    def remove(self, key: str) -> None:
        del self[key]


class _Cache(StatefulProcessor):
    def __init__(self, lifetime: int, purge_age: int, limit: int):
        self.rules = lifetime, purge_age, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "at long")
        self.size = handle.getValueState("size", "n long, timer long")

    def _open(self) -> tuple[_Entries, int]:
        n, timer = tuple(self.size.get()) if self.size.exists() else (0, 0)
        return _Entries(_Map(self.entries), n, *self.rules), timer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache, timer = self._open()
        asked = pd.concat(list(rows)).sort_values(["ts", "key"], kind="stable")
        out = []
        for name, ts in zip(asked["key"], asked["ts"], strict=True):
            now = ts.value // 1_000_000
            hit, purged = cache.ask(name, now)
            out.append((hit, cache.size, purged))
            if not timer:
                timer = now + self.rules[0]
                self.handle.registerTimer(timer)
        self.size.update((cache.size, timer))
        found = pd.DataFrame(out, columns=["hit", "entries", "purged"])
        yield pd.concat([asked[["cache", "key", "ts"]].reset_index(drop=True), found], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cache, _ = self._open()
        cache.expire(expiredTimerInfo.getExpiryTimeInMs())
        left = min((at for _, at in cache.entries.items()), default=None)
        timer = 0 if left is None else left + self.rules[0]
        if timer:
            self.handle.registerTimer(timer)
        self.size.update((cache.size, timer))
        return iter(())

    def close(self) -> None:
        pass


def _asked(rows: DataFrame, cache: str, key: str, ts: str, shards: int) -> DataFrame:
    name = F.col(cache).cast("string")
    own = F.concat_ws("/", name, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("string")) if shards > 1 else name
    return rows.select(F.coalesce(own, F.lit("")).alias("cache"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(ts).alias("ts"))


def cached(asked: DataFrame, *, cache: str = "cache", key: str = "key", ts: str = "ts", lifetime_ms: int = LIFETIME_MS, purge_age_ms: int = PURGE_AGE_MS, limit: int = LIMIT, shards: int = 1) -> DataFrame:
    """cache, key, ts, hit, entries (live or not yet removed, afterwards), purged of every row of a stream with a watermark on ``ts``; nulls are the empty name.

    Sets the session's state store to RocksDB, which maps and timers ask for.
    """
    asked.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _asked(asked, cache, key, ts, shards)
    return rows.groupBy("cache").transformWithStateInPandas(_Cache(lifetime_ms, purge_age_ms, max(1, limit // shards)), _OUT, "Append", "EventTime")


def replayed(asked: DataFrame, *, cache: str = "cache", key: str = "key", ts: str = "ts", lifetime_ms: int = LIFETIME_MS, purge_age_ms: int = PURGE_AGE_MS, limit: int = LIMIT, shards: int = 1) -> DataFrame:
    """The same rows from a finished table, in order of time; a cache's rows stream through one task, which holds its entries."""
    rules = lifetime_ms, purge_age_ms, max(1, limit // shards)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, entries = None, None
        for frame in frames:
            out = []
            for name, key_, ts_ in zip(frame["cache"], frame["key"], frame["ts"], strict=True):
                if name != now:
                    now, entries = name, _Entries(_Dict(), 0, *rules)
                hit, purged = entries.ask(key_, ts_.value // 1_000_000)
                out.append((name, key_, ts_, hit, entries.size, purged))
            yield pd.DataFrame(out, columns=["cache", "key", "ts", "hit", "entries", "purged"])

    rows = _asked(asked, cache, key, ts, shards).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.repartition("cache").sortWithinPartitions("cache", "ts", "key").mapInPandas(run, _OUT)
