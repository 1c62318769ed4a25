"""Queries over the star schema and the events: joins, sets, aggregates, packages, metrics and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import metrics, packages
from lodestone.operators.store import first_wins
from lodestone.plans.base import query, table
from lodestone.streaming import windows


@query("SELECT l_returnflag, sum(l_quantity) AS total, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_returnflag")
def share_of_total(spark, sf_dir):
    out = metrics.share_of_total(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_quantity"))
    return out.withColumn("share", F.round("share", 6))


@query("""SELECT o_custkey, max(o_orderdate) AS latest_date, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS latest, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS oldest
FROM orders GROUP BY o_custkey""")
def argmax_latest(spark, sf_dir):
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest_date"), F.max_by("o_orderkey", order).alias("latest"), F.min_by("o_orderkey", order).alias("oldest"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (k = floor((n - 1) * 50 / 100.0 + 0.5)) AS p50, max(value) FILTER (k = floor((n - 1) * 95 / 100.0 + 0.5)) AS p95, max(value) FILTER (k = floor((n - 1) * 99 / 100.0 + 0.5)) AS p99
FROM r GROUP BY event_type""")
def nearest_rank_percentiles(spark, sf_dir):
    return metrics.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", (50, 95, 99))


@query("""SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 200 THEN 1.0 ELSE 0 END), 6) AS slow_share,
  CASE WHEN avg(CASE WHEN value > 200 THEN 1.0 ELSE 0 END) > 0.15 THEN 'unhealthy' WHEN avg(value) > 50 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY user_id""")
def health_status(spark, sf_dir):
    out = metrics.health(table(spark, sf_dir, "events"), ["user_id"], "value", slow=200, share=0.15, mean=50)
    return out.withColumn("mean", F.round("mean", 6)).withColumn("slow_share", F.round("slow_share", 6))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) / count(*), 6) AS over_100 FROM events GROUP BY event_type""")
def tool_statistics(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.count_if(v > 100) / F.count("*"), 6).alias("over_100"))


@query("""SELECT event_id, round(avg(value) OVER w, 9) AS rolling_avg, count(value) OVER w AS rolling_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_last_n(spark, sf_dir):
    out = metrics.rolling_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 100)
    return out.select("event_id", F.round("rolling_avg", 9).alias("rolling_avg"), "rolling_n")


@query("""SELECT event_id, round(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) / 3600, 9) AS rate FROM events""")
def rolling_rate(spark, sf_dir):
    return metrics.rolling_rate(table(spark, sf_dir, "events"), ["user_id"], "ts", 3600).select("event_id", F.round("rate", 9).alias("rate"))


@query("""WITH l AS (SELECT user_id, list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)) AS vs FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(vs, lambda a, x: (a + x) / 2), 6) AS ema FROM l""")
def ema_half(spark, sf_dir):
    found = metrics.exponential_averages(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return found.withColumn("ema", F.round("ema", 6))


@query("""SELECT user_id, avg(value) AS mean, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 2 AND avg(value) > 40""")
def grouped_having(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).where("n >= 2 and mean > 40")


@query("""SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events""")
def json_navigation(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


# packages: parts stand for packages, orders for advisories
@query("""SELECT name, 'added' AS change FROM (SELECT p_brand || p_type AS name FROM part WHERE p_size = 2 EXCEPT SELECT p_brand || p_type FROM part WHERE p_size = 1)
UNION ALL SELECT name, 'removed' FROM (SELECT p_brand || p_type AS name FROM part WHERE p_size = 1 EXCEPT SELECT p_brand || p_type FROM part WHERE p_size = 2)""")
def feature_diff(spark, sf_dir):
    features = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("version"), F.concat("p_brand", "p_type").alias("name"))
    return packages.feature_diff(features, "1", "2")


_SEVERITY = "CASE o_orderstatus WHEN 'F' THEN 'severe' WHEN 'O' THEN 'important' WHEN 'P' THEN 'moderate' ELSE 'CVSS:3.1' END"


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS critical, count(*) FILTER (o_orderstatus = 'O') AS high, count(*) FILTER (o_orderstatus = 'P') AS medium, 0::BIGINT AS low, count(*) AS total FROM orders""")
def severity_counts(spark, sf_dir):
    return packages.severity_counts(table(spark, sf_dir, "orders").withColumn("severity", F.expr(_SEVERITY)))


@query("""WITH u AS (SELECT o_custkey AS id, 'a' AS source, o_orderkey AS k, 0 AS s FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'b', o_orderkey, 1 FROM orders)
SELECT id, source, k FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, k) = 1""")
def vuln_union_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    own = lambda df, name: df.select(F.col("o_custkey").alias("id"), F.lit(name).alias("source"), F.col("o_orderkey").alias("k"))
    return packages.union_first([own(rows.where("o_orderstatus = 'F'"), "a"), own(rows, "b")], ["id"], ["k"])


_ALERTS = """alerts AS (SELECT l_partkey AS k, list_sort(list_distinct(list(CASE l_returnflag WHEN 'R' THEN 'CRITICAL' WHEN 'A' THEN 'HIGH' ELSE 'UNKNOWN' END || ': ' || l_suppkey))) AS alerts FROM lineitem WHERE l_discount > 0.08 GROUP BY l_partkey),
latest AS (SELECT l_partkey AS k, max(l_linenumber)::VARCHAR AS latest_version FROM lineitem GROUP BY l_partkey)"""
_REPORT = f"""WITH {_ALERTS} SELECT p_partkey::VARCHAR AS name, len(coalesce(alerts, [])) AS n_alerts, coalesce((p_size % 7)::VARCHAR <> latest_version, false) AS update_available,
  CASE WHEN alerts IS NULL THEN 'NONE' WHEN list_bool_or(list_transform(alerts, lambda a: contains(a, 'CRITICAL'))) THEN 'CRITICAL' WHEN list_bool_or(list_transform(alerts, lambda a: contains(a, 'HIGH'))) THEN 'HIGH' ELSE 'UNKNOWN' END AS risk
FROM part LEFT JOIN alerts ON alerts.k = p_partkey LEFT JOIN latest ON latest.k = p_partkey"""


def _report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    deps = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") % 7).cast("string").alias("current_version"))
    latest = lines.groupBy(F.col("l_partkey").cast("string").alias("name")).agg(F.max("l_linenumber").cast("string").alias("latest_version"))
    label = F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "high").otherwise("CVSS")
    vulns = lines.where("l_discount > 0.08").select(F.col("l_partkey").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("id"), label.alias("severity"))
    return packages.dependency_report(deps, latest, vulns)


@query(_REPORT)
def dependency_report(spark, sf_dir):
    return _report(spark, sf_dir).select("name", F.size("alerts").alias("n_alerts"), "update_available", "risk")


@query(f"SELECT count(*) AS total, count(*) FILTER (n_alerts > 0) AS with_alerts, count(*) FILTER (update_available) AS updates FROM ({_REPORT})")
def dependency_summary(spark, sf_dir):
    return packages.dependency_summary(_report(spark, sf_dir))


# relational forms
@query("""SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0""")
def join_inner(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.where("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").na.fill(0, ["orders"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) b ON a.k = b.k""")
def join_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = table(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full_outer")


@query("""SELECT p_type, 'both' AS side FROM (SELECT p_type FROM part WHERE p_size < 10 INTERSECT SELECT p_type FROM part WHERE p_size > 45)
UNION ALL SELECT p_type, 'low' FROM (SELECT p_type FROM part WHERE p_size < 10 EXCEPT SELECT p_type FROM part WHERE p_size > 45)""")
def set_operations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    low, high = part.where("p_size < 10").select("p_type"), part.where("p_size > 45").select("p_type")
    return low.intersect(high).withColumn("side", F.lit("both")).union(low.subtract(high).withColumn("side", F.lit("low")))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_pricing(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return rows.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("revenue"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def top_revenue(spark, sf_dir):
    c, o, lines = (table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem"))
    joined = o.join(c.where("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey, "left_semi").join(lines, o.o_orderkey == lines.l_orderkey)
    return joined.groupBy("o_orderkey").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("revenue")).orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("""SELECT o_custkey, o_orderkey, rank() OVER w AS rank, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def ranking_windows(spark, sf_dir):
    by_price, by_date = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice")), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.rank().over(by_price).alias("rank"), (F.col("o_totalprice") - F.lag("o_totalprice").over(by_date)).alias("step"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_event(spark, sf_dir):
    return first_wins(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id")


# event-time windows, as batch; the same functions take streams
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), ["event_type"], "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 6))


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start""")
def sliding_counts(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"), [], "2 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new, event_id FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS end, count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    out = windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "30 minutes")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("""SELECT count(*) AS total, count(*) FILTER (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) > 864000) AS expired, count(*) FILTER (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) <= 864000) AS active FROM events""")
def cache_statistics(spark, sf_dir):
    return windows.cache_stats(table(spark, sf_dir, "events"), "2024-01-31", 864_000)


@query("SELECT event_type, count(value) AS n, true AS near FROM events GROUP BY event_type")
def quantile_sketches(spark, sf_dir):
    """Sketches of each type and day merged by type; whether its median and 95th percentile are within 1 % of n of the exact ones in rank."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    merged = metrics.merged_sketches(metrics.quantile_sketches(events, ["event_type", "day"], "value"), ["event_type"])
    found = metrics.quantiles(merged, ["event_type"], (50, 95))
    ranks = events.join(found, "event_type").groupBy("event_type", "n").agg(*[F.count_if(F.col("value") <= F.col(f"p{p}")).alias(f"r{p}") for p in (50, 95)])
    near = [F.abs(F.col(f"r{p}") / F.col("n") - p / 100) <= F.greatest(F.lit(0.01), 2 / F.col("n")) for p in (50, 95)]
    return ranks.select("event_type", "n", (near[0] & near[1]).alias("near"))
