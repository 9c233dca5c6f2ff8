"""Queries beside the format's own: joins by range and time, sets, cubes, overlays
and built-in functions; all Catalyst's own operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.catalog import _table, register
from quillon.operators import history
from quillon.operators.relational import as_of, band_join, small_enough


@register(
    "rel_range_join",
    """WITH b AS (SELECT unnest([0, 50000, 100000, 200000]) AS lo, unnest([50000, 100000, 200000, 1000000000]) AS hi)
SELECT o_orderkey, lo AS band FROM orders JOIN b ON o_totalprice >= lo AND o_totalprice < hi""",
)
def rel_range_join(spark, sf_dir):
    """Interval join against a few disjoint bands."""
    edges = spark.createDataFrame([(0, 50_000), (50_000, 100_000), (100_000, 200_000), (200_000, 1_000_000_000)], "lo int, hi int")
    joined = band_join(_table(spark, sf_dir, "orders"), "o_totalprice", edges, "lo", "hi")
    return joined.select("o_orderkey", F.col("lo").alias("band"))


@register(
    "rel_theta_join",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND a.n_name <> b.n_name",
)
def rel_theta_join(spark, sf_dir):
    a, b = (_table(spark, sf_dir, "nation").alias(x) for x in "ab")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_name") != F.col("b.n_name"))
    return a.join(b, on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@register(
    "rel_as_of",
    """WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'purchase'), p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.user_id, e.event_id, p.value AS last_value FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def rel_as_of(spark, sf_dir):
    """The latest purchase of the same user at or before each other event."""
    events = _table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    others = events.where("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    return as_of(others, bought, ["user_id"], "ts", ["last_value"]).select("user_id", "event_id", "last_value")


@register("rel_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def rel_lookup(spark, sf_dir):
    """Broadcast of a side whose size was looked at first."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    side = F.broadcast(names) if small_enough(names) else names
    return _table(spark, sf_dir, "customer").join(side, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@register("rel_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rel_cube(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@register("rel_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def rel_grouping_sets(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return _table(spark, sf_dir, "orders").groupingSets([[status], [priority], []], status, priority).agg(F.count("*").alias("n"))


@register("rel_distinct_aggregate", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def rel_distinct_aggregate(spark, sf_dir):
    agg = [F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n")]
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*agg)


@register("rel_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def rel_union(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k").union(_table(spark, sf_dir, "supplier").selectExpr("s_nationkey")).distinct()


@register("rel_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def rel_union_all(spark, sf_dir):
    both = _table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k").unionAll(_table(spark, sf_dir, "supplier").selectExpr("s_nationkey"))
    return both.groupBy("k").agg(F.count("*").alias("n"))


@register("rel_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def rel_except(spark, sf_dir):
    returned = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_partkey AS k")
    return _table(spark, sf_dir, "part").selectExpr("p_partkey AS k").subtract(returned)


@register("rel_global_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_global_topk(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@register("rel_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def rel_sort(spark, sf_dir):
    """Places in a global order: range-partitioned, then counted, no single task."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return history.global_places(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], "place").select("o_orderkey", "place")


@register(
    "rel_analytic",
    """SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def rel_analytic(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(w).cast("long").alias("q"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"),
    )


@register(
    "rel_functions",
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first,
  regexp_extract(o_orderpriority, '^([0-9])-', 1) AS level, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS letters, upper(substr(o_orderstatus, 1, 1)) AS s,
  CAST(floor(sqrt(o_totalprice)) AS BIGINT) AS root, CAST(o_custkey % 7 AS BIGINT) AS rest, greatest(o_custkey, 100) AS most FROM orders""",
)
def rel_functions(spark, sf_dir):
    date = F.col("o_orderdate")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(date).cast("long").alias("y"), F.month(date).cast("long").alias("m"), F.datediff(date, F.lit("1992-01-01")).cast("long").alias("days"),
        F.trunc(date, "month").cast("string").alias("first"), F.regexp_extract("o_orderpriority", "^([0-9])-", 1).alias("level"), F.regexp_replace("o_orderpriority", "[^A-Z]", "").alias("letters"),
        F.upper(F.substring("o_orderstatus", 1, 1)).alias("s"), F.floor(F.sqrt("o_totalprice")).cast("long").alias("root"), (F.col("o_custkey") % 7).alias("rest"),
        F.greatest("o_custkey", F.lit(100).cast("long")).alias("most"),
    )


@register(
    "positional_difference",
    """WITH a AS (SELECT conv_id, turn, role FROM conversations), p AS (SELECT conv_id + 1 AS conv_id, turn, role FROM conversations WHERE conv_id + 1 IN (SELECT conv_id FROM conversations))
SELECT coalesce(a.conv_id, p.conv_id) AS conv_id, coalesce(a.turn, p.turn) AS turn, CASE WHEN p.turn IS NULL THEN 'APPEND' WHEN a.turn IS NULL THEN 'TRUNCATE' WHEN a.role = p.role THEN 'KEEP' ELSE 'REPLACE' END AS operation
FROM a FULL JOIN p ON a.conv_id = p.conv_id AND a.turn = p.turn""",
)
def positional_difference(spark, sf_dir):
    """What turns the list before into this one, place by place."""
    now = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    before = now.withColumn("conv_id", F.col("conv_id") + 1).join(now.select("conv_id").distinct(), "conv_id", "left_semi")
    return history.positional_operations(before, now, ["conv_id"], "turn", "role").select("conv_id", "turn", "operation")


@register(
    "template_overlay",
    """WITH b AS (SELECT user_id % 4 AS source, event_id // 16 AS batch, list(event_type ORDER BY event_id) AS t, list(user_id ORDER BY event_id) AS u FROM events GROUP BY 1, 2)
SELECT source, batch, array_to_string(t, ',') AS event_type, array_to_string(u, ',') AS user_id FROM b""",
)
def template_overlay(spark, sf_dir):
    """Batches rebuilt from the columns that changed since the batch before."""
    rows = _table(spark, sf_dir, "events").selectExpr("user_id % 4 AS source", "event_id div 16 AS batch", "event_id", "event_type", "user_id")
    sent = history.template_changes(rows, ["source"], "batch", ["event_id"], ["event_type", "user_id"])
    whole = history.replay(sent, ["source"], ["batch"], ["event_type", "user_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return whole.select("source", "batch", joined("event_type"), joined("user_id"))
