"""Queries of version orders and affected ranges, over versions of all forms that parts and order lines make up."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import version_keys
from lodestone.operators import ranges
from lodestone.plans.base import list_sql, query, table

# endings in their standard's order
_SEMVER = ["-alpha", "-alpha.1", "-alpha.beta", "-beta", "-beta.2", "-beta.11", "-rc.1", ""]
_PEP440 = [".dev2", "a1.dev3", "a1", "a10", "b2", "rc1", "", "+abc", "+5", ".post1.dev1", ".post1"]
_MAVEN = ["-alpha-1", "-alpha-2", "-beta", "-milestone-1", "-rc1", "-SNAPSHOT", "", "-sp", "-abc", "-1", ".1"]


def _order_sql(endings: list[str], before: str = "''", first: str = "0") -> str:
    ending = f"p_partkey % {len(endings)}"
    version = f"{before} || p_size || '.' || (p_partkey % 13) || {list_sql(endings)}[{ending} + 1]"
    return f"SELECT p_partkey, {version} AS version, rank() OVER (PARTITION BY p_brand ORDER BY {first}, p_size, p_partkey % 13, {ending}) AS rank FROM part"


def _order(spark, sf_dir, scheme, endings, before=""):
    ending = F.element_at(F.array(*map(F.lit, endings)), (F.col("p_partkey") % len(endings) + 1).cast("int"))
    start = F.when(F.col("p_partkey") % 10 == 0, before).otherwise("")
    rows = table(spark, sf_dir, "part").withColumn("version", F.concat(start, F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), ending))
    key = version_keys.SCHEMES[scheme](F.col("version"))
    return rows.select("p_partkey", "version", F.rank().over(Window.partitionBy("p_brand").orderBy(key)).alias("rank"))


@query(_order_sql(_SEMVER))
def version_order_semver(spark, sf_dir):
    return _order(spark, sf_dir, "semver", _SEMVER)


@query(_order_sql(_PEP440, "CASE WHEN p_partkey % 10 = 0 THEN '1!' ELSE '' END", "p_partkey % 10 = 0"))
def version_order_pep440(spark, sf_dir):
    return _order(spark, sf_dir, "pep440", _PEP440, "1!")


@query(_order_sql(_MAVEN))
def version_order_maven(spark, sf_dir):
    return _order(spark, sf_dir, "maven", _MAVEN)


# order lines stand for dependencies, parts for advisories; numbers of at most three digits compare as one number
_DEPENDENCIES = """d AS (SELECT l_orderkey, l_linenumber, 'pkg' || l_suppkey AS name,
  l_linenumber || '.' || l_quantity::INT || '.' || (l_orderkey % 10) || CASE WHEN l_returnflag = 'R' THEN '-rc.1' ELSE '' END AS version,
  l_linenumber * 10000000 + l_quantity::INT * 10000 + (l_orderkey % 10) * 10 + CASE WHEN l_returnflag = 'R' THEN 0 ELSE 5 END AS num FROM lineitem),
r AS (SELECT 'A' || p_partkey AS id, 'pkg' || (p_partkey % 50 + 1) AS name, p_size % 5 AS level, (p_size % 7 + 1) * 10000000 + (p_partkey % 50) * 10000 + 5 AS low,
  CASE p_size % 3 WHEN 0 THEN 99999999999 WHEN 1 THEN (p_size % 7 + 2) * 10000000 + 5 ELSE (p_size % 7 + 1) * 10000000 + 490000 + 95 + 1 END AS high,
  CASE WHEN p_size % 3 = 1 THEN p_size % 7 + 2 END AS fix FROM part)"""


def _tables(spark, sf_dir):
    number = lambda c: F.col(c).cast("int").cast("string")
    version = F.concat(F.concat_ws(".", number("l_linenumber"), number("l_quantity"), (F.col("l_orderkey") % 10).cast("string")), F.when(F.col("l_returnflag") == "R", "-rc.1").otherwise(""))
    deps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg"), "l_suppkey").alias("name"), version.alias("version"))
    part, kind, major = table(spark, sf_dir, "part"), F.col("p_size") % 3, F.col("p_size") % 7
    found = part.select(
        F.concat(F.lit("A"), "p_partkey").alias("id"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("pkg"), (F.col("p_partkey") % 50 + 1).cast("string")).alias("package"),
        F.element_at(F.array(*map(F.lit, ("severe", "important", "moderate", "minor", "?"))), F.col("p_size") % 5 + 1).alias("severity"),
        F.concat_ws(".", (major + 1).cast("string"), (F.col("p_partkey") % 50).cast("string"), F.lit("0")).alias("introduced"),
        F.when(kind == 1, F.concat((major + 2).cast("string"), F.lit(".0.0"))).alias("fixed"), F.when(kind == 2, F.concat((major + 1).cast("string"), F.lit(".49.9"))).alias("last_affected"),
    )
    return deps, found


@query(f"WITH {_DEPENDENCIES} SELECT l_orderkey, l_linenumber, id, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'][level + 1] AS alert_severity FROM d JOIN r ON d.name = r.name AND low <= num AND num < high")
def affected_dependencies(spark, sf_dir):
    return ranges.affected(*_tables(spark, sf_dir)).select("l_orderkey", "l_linenumber", "id", "alert_severity")


@query(f"""WITH {_DEPENDENCIES}, f AS (SELECT d.name, num, count(*) AS n, min(level) AS worst, CASE WHEN bool_or(fix IS NULL) THEN NULL ELSE max(fix) || '.0.0' END AS fixed_in FROM (SELECT DISTINCT name, num FROM d) d JOIN r ON d.name = r.name AND low <= num AND num < high GROUP BY 1, 2)
SELECT d.l_orderkey, d.l_linenumber, d.name, d.version, coalesce(n, 0) AS n_alerts, coalesce(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'][worst + 1], 'NONE') AS risk, fixed_in FROM d LEFT JOIN f ON f.name = d.name AND f.num = d.num""")
def vulnerability_report(spark, sf_dir):
    return ranges.vulnerability_report(*_tables(spark, sf_dir)).select("l_orderkey", "l_linenumber", "name", "version", "n_alerts", "risk", "fixed_in")
