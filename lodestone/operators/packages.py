"""Releases, dependencies and vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.versions import severity
from lodestone.operators.store import first_wins


def feature_diff(features: DataFrame, old: str, new: str) -> DataFrame:
    """name, change: added or removed between two versions of (version, name)."""
    a, b = (features.where(F.col("version") == v).select("name").distinct() for v in (old, new))
    added = b.join(a, "name", "left_anti").withColumn("change", F.lit("added"))
    return added.union(a.join(b, "name", "left_anti").withColumn("change", F.lit("removed")))


def union_first(sources: list[DataFrame], keys: list[str], order: list | None = None) -> DataFrame:
    """All rows of all sources; for equal keys that of the earliest source, then the first by ``order``."""
    rows = None
    for k, s in enumerate(sources):
        tagged = s.withColumn("__source", F.lit(k))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return first_wins(rows, keys, ["__source", *(order or [])]).drop("__source")


def severity_counts(vulnerabilities: DataFrame, column: str = "severity") -> DataFrame:
    own = severity(F.col(column))
    return vulnerabilities.agg(*[F.count_if(own == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], F.count("*").alias("total"))


def dependency_report(dependencies: DataFrame, latest: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Dependencies with latest version, alerts (sorted), update flag and the highest risk; missing facts stay null or empty."""
    alerts = vulnerabilities.groupBy("name").agg(F.array_sort(F.collect_set(F.concat(severity(F.col("severity")), F.lit(": "), "id"))).alias("alerts"))
    out = dependencies.join(latest, "name", "left").join(alerts, "name", "left")
    out = out.withColumn("alerts", F.coalesce("alerts", F.array().cast("array<string>")))
    return out.withColumn("update_available", F.coalesce(F.col("current_version") != F.col("latest_version"), F.lit(False))).withColumn("risk", risk(F.col("alerts")))


def risk(alerts: Column) -> Column:
    """The first of CRITICAL, HIGH, MEDIUM, LOW that an alert names; NONE without alerts, UNKNOWN for others."""
    named = lambda s: F.exists(alerts, lambda a: F.contains(F.upper(a), F.lit(s)))
    out = F.when(F.size(alerts) == 0, "NONE")
    for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"):
        out = out.when(named(s), s)
    return out.otherwise("UNKNOWN")


def dependency_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("total"), F.count_if(F.size("alerts") > 0).alias("with_alerts"), F.count_if("update_available").alias("updates"))


def timeline(releases: DataFrame, since: str | None = None) -> DataFrame:
    """Per version, newest first: counts and the names of features of high impact. ``since`` compares as text."""
    rows = releases if since is None else releases.where(F.col("version") >= since)
    high = F.transform(F.filter("features", lambda f: f["impact"] == "High"), lambda f: f["name"])
    return rows.select("language", "version", "release_date", F.size("features").alias("features"), F.size("breaking_changes").alias("breaking"), high.alias("high_impact")).orderBy(F.desc("release_date"), "version")


def search_features(releases: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """One row per feature whose name, description or any tag holds the query."""
    rows = releases.select("language", "version", F.explode("features").alias("f"))
    lower = query.lower()
    hit = F.contains(F.lower("f.name"), F.lit(lower)) | F.contains(F.lower("f.description"), F.lit(lower)) | F.exists("f.tags", lambda t: F.contains(F.lower(t), F.lit(lower)))
    if category is not None:
        hit = hit & (F.col("f.category") == category)
    return rows.where(hit).select("language", "version", "f.*")


def without_fix(vulnerabilities: DataFrame) -> DataFrame:
    return vulnerabilities.where(F.coalesce(F.size("fixed_versions"), F.lit(0)) == 0)


def manifest_counts(dependencies: DataFrame, language: str = "language") -> DataFrame:
    """language, total, dev of parsed dependencies; rows of files that could not be read do not count."""
    return dependencies.where("name is not null").groupBy(language).agg(F.count("*").alias("total"), F.count_if(F.col("kind").isin("dev", "test")).alias("dev"))


def suggestions_at_least(suggestions: Column, severity_order: tuple[str, ...], least: str, *, examples: bool = True) -> Column:
    """Of array<struct<severity, message, example>> those of at least the severity, with or without their examples."""
    order = F.array(*[F.lit(s) for s in severity_order])
    kept = F.filter(suggestions, lambda s: F.array_position(order, s["severity"]) >= severity_order.index(least) + 1)
    return kept if examples else F.transform(kept, lambda s: s.dropFields("example"))


def library_statistics(libraries: DataFrame) -> DataFrame:
    """Over libraries (quality double, apis and tutorials arrays): mean quality and list sizes."""
    return libraries.agg(F.avg("quality").alias("quality"), F.sum(F.size("apis")).alias("apis"), F.sum(F.size("tutorials")).alias("tutorials"))
