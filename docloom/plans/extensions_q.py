"""Extensions beyond the reference, for the supplied tables: grouping sets, sessions, as-of values, column profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.plans.base import Tables, query


@query("x1_pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus")
def x1(spark, sf):
    rows = Tables(spark, sf).lineitem.filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("x2_rollup", "SELECT c_mktsegment, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def x2(spark, sf):
    t = Tables(spark, sf)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


@query("x3_sessions", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, session")
def x3(spark, sf):
    """Sessions that end after six idle hours."""
    per = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(seconds).over(per)
    g = Tables(spark, sf).events.withColumn("new", F.when(before.isNull() | (seconds - before > 6 * 3600 * 1_000_000), 1).otherwise(0))
    return g.withColumn("session", F.sum("new").over(per)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("x4_as_of_value", "SELECT a.event_id, b.value AS last_error FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def x4(spark, sf):
    """Each purchase with the user's latest error before it: one window over both, no join."""
    events = Tables(spark, sf).events.filter("event_type in ('purchase', 'error')")
    before = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "error", 0).otherwise(1))
    found = events.withColumn("last_error", F.last(F.when(F.col("event_type") == "error", F.col("value")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return found.filter("event_type = 'purchase'").select("event_id", "last_error")


@query("x5_column_profile", "SELECT 'p_brand' AS name, CAST(count(DISTINCT p_brand) AS BIGINT) AS kinds, min(p_brand) AS low, max(p_brand) AS high FROM part UNION ALL SELECT 'p_type', CAST(count(DISTINCT p_type) AS BIGINT), min(p_type), max(p_type) FROM part UNION ALL SELECT 'p_name', CAST(count(DISTINCT p_name) AS BIGINT), min(p_name), max(p_name) FROM part")
def x5(spark, sf):
    """One profile per text column: an unpivot and one aggregate."""
    long = Tables(spark, sf).part.select("p_brand", "p_type", "p_name").unpivot([], ["p_brand", "p_type", "p_name"], "name", "value")
    return long.groupBy("name").agg(F.countDistinct("value").alias("kinds"), F.min("value").alias("low"), F.max("value").alias("high"))
