"""Relational categories over the star schema: joins, sets, grouping, windows, pivots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import tables

QUERIES, SQL = {}, {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], SQL[name] = f, oracle
        return f

    return add


def read(spark, sf_dir, *names):
    return [tables.table(spark, sf_dir, n) for n in names]


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    (line,) = read(spark, sf_dir, "lineitem")
    return line.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    customer, orders, line, nation, region = read(spark, sf_dir, "customer", "orders", "lineitem", "nation", "region")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark, sf_dir):
    customer, orders = read(spark, sf_dir, "customer", "orders")
    return customer.select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("customers_with_large_orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def customers_with_large_orders(spark, sf_dir):
    customer, orders = read(spark, sf_dir, "customer", "orders")
    return customer.select("c_custkey").join(orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("order_cube", "SELECT coalesce(o_orderstatus, 'all') AS status, CAST(coalesce(year(o_orderdate), 0) AS BIGINT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, year(o_orderdate))")
def order_cube(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    rows = orders.select("o_orderstatus", F.year("o_orderdate").alias("y"), "o_totalprice").cube("o_orderstatus", "y").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("y", F.lit(0)).cast("long").alias("year"), "n", "total")


@query("order_pivot", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def order_pivot(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    return orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("top_orders", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_orders(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return orders.select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rank", place).where("rank <= 3").drop("o_totalprice")


@query("order_gaps", "SELECT o_orderkey, CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS BIGINT) AS gap, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def order_gaps(spark, sf_dir):
    (orders,) = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("gap"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("key_sets", "(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT n_nationkey, 'neither' FROM nation EXCEPT (SELECT c_nationkey, 'neither' FROM customer UNION SELECT s_nationkey, 'neither' FROM supplier))")
def key_sets(spark, sf_dir):
    customer, supplier, nation = (d.select(F.col(c).alias("k")) for d, c in zip(read(spark, sf_dir, "customer", "supplier", "nation"), ("c_nationkey", "s_nationkey", "n_nationkey"), strict=True))
    return customer.intersect(supplier).withColumn("side", F.lit("both")).unionByName(nation.subtract(customer.union(supplier)).withColumn("side", F.lit("neither")))


@query("as_of_events", "SELECT a.event_id, b.event_id AS before FROM (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of_events(spark, sf_dir):
    """The last event of one kind before each of another, a user: one window over both, no range join."""
    (events,) = read(spark, sf_dir, "events")
    ends = events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    rows = events.crossJoin(F.broadcast(ends)).where("event_type in (lo, hi)")
    last = F.last(F.when(F.col("event_type") == F.col("hi"), F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("before", last).where("event_type = lo").select("event_id", "before")
