"""Which advisories touch which dependencies, by intervals of versions.

An advisory's events (introduced, fixed, last affected) become intervals of version keys (``functions.version_keys``). The different versions of a package that occur at
all, and the package's intervals, are sorted by key and swept once: an interval opens where it begins and closes where it
ends, and every version meets those that are open. Equal versions are swept once whatever the number of rows that have them, and the sweep streams: a
task holds the open intervals of one package.

Defined results: an interval without a beginning starts with the first version, one without an end is open; one that ends before it begins holds nothing; a version or
an end that is no version of its registry's standard matches nothing (a beginning of "0" always is one); rows without package match nothing; repeated
rows are rows; equal intervals of one advisory count once.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.version_keys import key
from lodestone.functions.versions import severity
from lodestone.runtime import ship_package

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN")  # fixed values, the worst first


def osv_ranges(replies: DataFrame, column: str = "reply") -> DataFrame:
    """id, ecosystem, package, severity, introduced, fixed, last_affected: a row for each interval that an OSV document states.

    Events come in the document's order; each ``introduced`` opens an interval that the next ``fixed`` or ``last_affected`` closes. A version list without events
    gives an interval for each version.
    """
    event = "struct<introduced:string,fixed:string,last_affected:string>"
    shape = f"struct<id:string,database_specific:struct<severity:string>,affected:array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,ranges:array<struct<type:string,events:array<{event}>>>>>>"
    one = replies.select(F.from_json(column, shape).alias("v")).select("v.id", F.col("v.database_specific.severity").alias("severity"), F.explode("v.affected").alias("a"))
    one = one.select("id", "severity", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"), "a.versions", F.filter(F.col("a.ranges"), lambda r: F.coalesce(r["type"], F.lit("")) != "GIT").alias("ranges"))
    named = ["id", "ecosystem", "package", "severity"]
    events = one.select(*named, F.explode("ranges").alias("r")).select(*named, F.col("r.events").alias("e"), F.posexplode("r.events").alias("at", "x")).where("x.introduced is not null")
    after = F.get(F.filter(F.slice("e", F.col("at") + 2, F.size("e")), lambda x: x["introduced"].isNull()), 0)
    following = F.get(F.col("e"), F.col("at") + 1)
    closed = F.when(following["introduced"].isNull(), after)
    found = events.select(*named, F.col("x.introduced").alias("introduced"), closed["fixed"].alias("fixed"), closed["last_affected"].alias("last_affected"))
    listed = one.where("coalesce(size(ranges), 0) < 1").select(*named, F.explode("versions").alias("introduced"))
    return found.unionByName(listed.select(*named, "introduced", F.lit(None).cast("string").alias("fixed"), F.col("introduced").alias("last_affected")))


def _ends(ranges: DataFrame) -> DataFrame:
    """name, id, low (from it on), high (up to it, the end itself where ``closed``), severity, fixed, fix_key."""
    own = F.col("ecosystem")
    low = F.when(F.coalesce("introduced", F.lit("0")) == "0", "").otherwise(key(F.col("introduced"), own))
    end = F.coalesce("fixed", "last_affected")
    # no key begins with a sign above the letters, so this one ends all
    high = F.when(end.isNull(), "~").otherwise(key(end, own))
    return ranges.select(F.col("package").alias("name"), "id", low.alias("low"), high.alias("high"), F.col("fixed").isNull().alias("closed"), severity(F.col("severity")).alias("severity"), "fixed", key(F.col("fixed"), F.split("package", "\n")[0]).alias("fix_key")).where("name is not null and low is not null and high is not null").distinct()


def _chosen(open_: list[tuple]) -> list[tuple]:
    """Of the open intervals (end, id, severity, fixed, fix_key) that of each id which ends first."""
    best: dict[str, tuple] = {}
    for x in open_:
        if x[2] not in best or x[:1] + x[3:5] < best[x[2]][:1] + best[x[2]][3:5]:
            best[x[2]] = x
    return list(best.values())


def _swept(events: DataFrame, schema: str, found: Callable[[list[tuple]], list[pa.Array]]) -> DataFrame:
    """name, at (a version's key) and the columns that ``found`` makes of the intervals that hold it. They are made anew only where an interval has begun or
    ended since the last version. ``events``: name, at, kind (0 an interval begins, 1 a version), id, high, closed, severity, fixed, fix_key."""
    names = ["name", "at", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[pa.Array]] = []
        rows, now, open_, made = 0, None, [], None
        for batch in batches:
            for name, at, kind, id_, high, closed, level, fixed, fix_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    now, open_, made = name, [], None
                while open_ and (open_[0][0], open_[0][1]) < (at.encode(), 1):  # an end at this very version still holds it where it is closed
                    heapq.heappop(open_)
                    made = None
                if kind == 0:
                    heapq.heappush(open_, (high.encode(), int(closed), id_ or "", level or "", fixed or "", (fix_key or "").encode()))
                    made = None
                elif open_:
                    made = found(_chosen(open_)) if made is None else made
                    out.append([pa.repeat(name, len(made[0])), pa.repeat(at, len(made[0])), *made])
                    rows += len(made[0])
                    if rows >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=names)
                        out, rows = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=names)

    own = events.repartition("name").sortWithinPartitions("name", "at", "kind")
    return own.select("name", "at", "kind", "id", "high", "closed", "severity", "fixed", "fix_key").mapInArrow(run, f"name string, at string, {schema}")


def _each(held: list[tuple]) -> list[pa.Array]:
    return [pa.array([x[2] for x in held], pa.string()), pa.array([x[3] or None for x in held], pa.string()), pa.array([x[4] or None for x in held], pa.string())]


def _summary(held: list[tuple]) -> list[pa.Array]:
    fixes = [(x[5], x[4]) for x in held if x[5]]
    worst = min((SEVERITIES.index(x[3]) + 1 if x[3] in SEVERITIES else 0 for x in held if x[3]), default=None)
    return [
        pa.array([len(held)], pa.int64()), pa.array([worst], pa.int32()), pa.array([any(not x[4] for x in held)], pa.bool_()), pa.array([max(fixes)[1] if fixes else None], pa.string()),
    ]


def _events(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """Versions that occur and beginnings of intervals, for ``_swept``."""
    ship_package(dependencies.sparkSession)
    full = lambda name: F.concat_ws("\n", F.lower(F.coalesce("ecosystem", F.lit(""))), name)
    none = F.lit(None).cast("string")
    points = dependencies.where("name is not null").select(full(F.col("name")).alias("name"), key(F.col("version"), F.col("ecosystem")).alias("at")).where("at is not null").distinct()
    ends = _ends(ranges.withColumn("package", F.when(F.col("package").isNotNull(), full(F.col("package")))))
    points = points.select("name", "at", F.lit(1).alias("kind"), none.alias("id"), none.alias("high"), F.lit(False).alias("closed"), none.alias("severity"), none.alias("fixed"), none.alias("fix_key"))
    return points.unionByName(ends.select("name", F.col("low").alias("at"), F.lit(0).alias("kind"), "id", "high", "closed", "severity", "fixed", "fix_key"))


def affected_versions(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """name, at (version key), id, severity, fixed: each version that occurs beside each advisory that holds it, once.

    ``dependencies``: ecosystem, name, version. ``ranges``: id, ecosystem, package, severity, introduced, fixed, last_affected. Of several intervals of an advisory that hold a
    version, the one that ends first counts.
    """
    return _swept(_events(dependencies, ranges), "id string, severity string, fixed string", _each)


def _named(dependencies: DataFrame) -> DataFrame:
    full = F.when(F.col("name").isNotNull(), F.concat_ws("\n", F.lower(F.coalesce("ecosystem", F.lit(""))), "name"))
    return dependencies.withColumn("__name", full).withColumn("__at", key(F.col("version"), F.col("ecosystem")))


def affected(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """The dependencies' columns, and id, alert_severity and fixed of each advisory that holds the version: one row a pair."""
    found = affected_versions(dependencies, ranges).select(F.col("name").alias("__name"), F.col("at").alias("__at"), "id", F.col("severity").alias("alert_severity"), "fixed")
    return _named(dependencies).join(found, ["__name", "__at"]).drop("__name", "__at")


def vulnerability_report(dependencies: DataFrame, ranges: DataFrame) -> DataFrame:
    """The dependencies' columns, n_alerts, risk (the worst severity, or NONE) and fixed_in: the latest of the alerts' fixes, null where an alert has none.

    Alerts are counted in the sweep, a row for each different version, so neither pairs of versions and alerts nor lists of alerts are made.
    """
    counts = _swept(_events(dependencies, ranges), "n_alerts long, worst int, no_fix boolean, fix string", _summary)
    counts = counts.withColumnsRenamed({"name": "__name", "at": "__at"})
    out = _named(dependencies).join(counts, ["__name", "__at"], "left")
    risk: Column = F.lit("NONE")
    for k, level in enumerate(SEVERITIES, 1):
        risk = F.when(F.col("worst") == k, level).otherwise(risk)
    return out.select(*dependencies.columns, F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"), risk.alias("risk"), F.when(~F.col("no_fix"), F.col("fix")).alias("fixed_in"))
