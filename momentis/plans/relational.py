"""General relational coverage on the star schema: joins of every kind, set operations, grouping sets, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from momentis.plans.registry import query
from momentis.session import table


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")  # fmt: skip
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name""")  # fmt: skip
def revenue_by_nation(spark, sf_dir):
    """The dimensions (at most 25 nations) are broadcast by size; the two large joins go by key."""
    t = lambda name: table(spark, sf_dir, name)
    first = t("region").agg(F.min("r_name").alias("r_name"))
    nations = t("nation").join(t("region").join(first, "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = t("orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("outer_joins", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def outer_joins(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    marks = orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 200000).alias("big"), F.bool_or(F.col("o_orderstatus") == "P").alias("open"))
    joined = table(spark, sf_dir, "customer").join(marks, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.where("not coalesce(open, false)").select("c_custkey", F.coalesce("big", F.lit(False)).alias("big"))


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("cube_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("set_operations", """SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    return c.intersect(s).agg(F.lit("both").alias("side"), F.count("*").alias("n")).unionByName(c.subtract(s).agg(F.lit("customers").alias("side"), F.count("*").alias("n")))


@query("window_ranks", """SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS rank, CAST(dense_rank() OVER w AS BIGINT) AS dense, CAST(ntile(4) OVER k AS BIGINT) AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), k AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")  # fmt: skip
def window_ranks(spark, sf_dir):
    w, k = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ranks = {"rank": F.rank().over(w).cast("long"), "dense": F.dense_rank().over(w).cast("long"), "quarter": F.ntile(4).over(k).cast("long"), "pr": F.round(F.percent_rank().over(w), 6), "cd": F.round(F.cume_dist().over(w), 6)}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in ranks.items()))


@query("top_customers", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25")
def top_customers(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return spent.orderBy(F.desc("total"), "o_custkey").limit(25).select("o_custkey", F.round("total", 2).alias("spent"))


@query("upsert", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS status FROM orders")
def upsert(spark, sf_dir):
    """New rows replace old ones of their key: an anti join and a union, as a merge over immutable files."""
    from momentis.sources.tables import upsert as put

    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = old.where("status = 'P'").withColumn("status", F.lit("F"))
    return put(old, new, ["o_orderkey"])


@query("last_writer_wins", """WITH w AS (SELECT user_id AS k, event_id AS seq, event_type AS op, value AS x FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM w) SELECT k, x FROM r WHERE n = 1 AND op <> 'error'""")
def last_writer_wins(spark, sf_dir):
    """The latest write of each key; a tombstone removes it."""
    from momentis.sources.tables import last_writes

    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.col("value").alias("x"), (F.col("event_type") == "error").alias("gone"))
    return last_writes(log, ["k"], "seq", "gone").select("k", "x")


@query("bounded_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def bounded_history(spark, sf_dir):
    from momentis.sources.tables import keep_last

    return keep_last(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 20).select("user_id", "event_id")
