"""Intervals of versions against looking at every pair."""

import json
import random

from pyspark.sql import functions as F

from lodestone.operators import ranges

VERSIONS = ["0.1.0", "0.9.0", "1.0.0-alpha", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0-beta", "1.10.0", "2.0.0-0", "2.0.0", "10.0.0"]  # in order
DEPENDENCY = "row long, ecosystem string, name string, version string, fixed string"
RANGE = "id string, ecosystem string, package string, severity string, introduced string, fixed string, last_affected string"
LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNKNOWN"]


def _holds(version, introduced, fixed, last):
    at = VERSIONS.index(version)
    low = 0 if introduced in (None, "0") else VERSIONS.index(introduced)
    return low <= at and (fixed is None or at < VERSIONS.index(fixed)) and (fixed is not None or last is None or at <= VERSIONS.index(last))


def _tables(spark, seed):
    rng = random.Random(seed)
    version = lambda *more: rng.choice([*VERSIONS, *more])
    deps = [(k, "npm", f"p{min(rng.randrange(12), 5)}", version(), "own") for k in range(600)]
    found = []
    for k in range(80):
        fixed = rng.choice([None, version()])
        found.append((f"A{k % 60}", "npm", f"p{rng.randrange(6)}", rng.choice(["Severe", "moderate", "low", None]), rng.choice(["0", None, version()]), fixed, None if fixed else rng.choice([None, version()])))
    return deps, found


def test_sweep_is_every_pair(spark):
    for seed in range(3):
        deps, found = _tables(spark, seed)
        want = {(d[0], r[0]) for d in deps for r in found if d[2] == r[2] and _holds(d[3], *r[4:])}
        deps_, found_ = spark.createDataFrame(deps, DEPENDENCY), spark.createDataFrame(found + found[:20], RANGE)
        got = ranges.affected(deps_.withColumnRenamed("fixed", "note"), found_).select("row", "id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        report = {r.row: r for r in ranges.vulnerability_report(deps_.withColumnRenamed("fixed", "note"), found_).collect()}
        assert len(report) == len(deps)
        for d in deps:
            assert report[d[0]].n_alerts == sum(p[0] == d[0] for p in want)
            assert (report[d[0]].risk == "NONE") == (report[d[0]].n_alerts == 0)


def test_hot_package_is_swept_by_its_versions(spark):
    """Two thirds of the rows are one version of one package: what meets the intervals is a row for each different version."""
    deps = spark.range(3000).select(F.col("id").alias("row"), F.lit("npm").alias("ecosystem"), F.lit("p").alias("name"), F.when(F.col("id") % 3 > 0, "1.0.0").otherwise(F.concat(F.lit("1."), F.col("id") % 7, F.lit(".0"))).alias("version"))
    found = spark.createDataFrame([("A", "npm", "p", "high", "1.0.0", "1.3.0", None), ("B", "npm", "p", "low", "1.2.0", None, None)], RANGE)
    assert ranges.affected_versions(deps, found).count() == 3 + 5
    counted = {(r.n_alerts, r.risk, r.fixed_in): r["count"] for r in ranges.vulnerability_report(deps, found).groupBy("n_alerts", "risk", "fixed_in").count().collect()}
    assert sum(counted.values()) == 3000 and set(counted) == {(1, "HIGH", "1.3.0"), (2, "HIGH", None), (1, "LOW", None)}


def test_each_registry_has_its_own_order(spark):
    deps = spark.createDataFrame([(1, "PyPI", "p", "1.0.post1"), (2, "PyPI", "p", "1.0rc1"), (3, "Maven", "p", "1.0-SNAPSHOT"), (4, "Maven", "p", "1.0-sp"), (5, "npm", "p", "latest"), (6, None, None, "1"), (7, "PyPI", "p", None)], "row int, ecosystem string, name string, version string")
    found = spark.createDataFrame([("P", "PyPI", "p", "high", "1.0", "1.1", None), ("M", "Maven", "p", "high", "0", None, "1.0"), ("N", "npm", "p", "high", "0", None, None), ("X", "npm", None, "high", "0", None, None), ("Y", "PyPI", "p", "high", "x", "y", None)], RANGE)
    assert sorted(tuple(r) for r in ranges.affected(deps, found).select("row", "id").collect()) == [(1, "P"), (3, "M")]
    report = {r.row: (r.n_alerts, r.risk, r.fixed_in) for r in ranges.vulnerability_report(deps, found).collect()}
    assert report == {1: (1, "HIGH", "1.1"), 2: (0, "NONE", None), 3: (1, "HIGH", None), 4: (0, "NONE", None), 5: (0, "NONE", None), 6: (0, "NONE", None), 7: (0, "NONE", None)}
    assert ranges.affected(deps.limit(0), found).count() == 0 and ranges.vulnerability_report(deps, found.limit(0)).where("n_alerts > 0").count() == 0


def test_osv_events(spark):
    doc = {"id": "G", "database_specific": {"severity": "HIGH"}, "affected": [
        {"package": {"ecosystem": "npm", "name": "p"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.0"}, {"introduced": "2.0"}, {"last_affected": "2.5"}, {"introduced": "3.0"}]}, {"type": "GIT", "events": [{"introduced": "0"}]}]},
        {"package": {"ecosystem": "npm", "name": "q"}, "versions": ["1.1", "1.2"]}]}
    rows = spark.createDataFrame([(json.dumps(doc),), ("no json",), (None,)], "reply string")
    got = sorted((tuple(r) for r in ranges.osv_ranges(rows).select("package", "introduced", "fixed", "last_affected").collect()), key=str)
    assert got == [("p", "0", "1.0", None), ("p", "2.0", None, "2.5"), ("p", "3.0", None, None), ("q", "1.1", None, "1.1"), ("q", "1.2", None, "1.2")]


def test_a_report_makes_a_row_a_version_not_a_pair(spark):
    deps = spark.createDataFrame([("npm", "a", f"1.{k}.0") for k in range(30)], "ecosystem string, name string, version string")
    rows = [(f"A{k}", "npm", "a", "severe", "1.0.0", "2.0.0" if k % 2 else "10.0.0", None) for k in range(20)]
    found = spark.createDataFrame(rows, "id string, ecosystem string, package string, severity string, introduced string, fixed string, last_affected string")
    counts = ranges._swept(ranges._events(deps, found), "n_alerts long, worst int, no_fix boolean, fix string", ranges._summary).collect()
    assert len(counts) == 30 and {r["n_alerts"] for r in counts} == {20}
    assert {r["fix"] for r in counts} == {"10.0.0"} and not any(r["no_fix"] for r in counts)
