"""Joins, sets, groupings, windows and streams on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.stats import rounded
from seqloom.operators import relational as rel
from seqloom.plans.registry import query
from seqloom.sources.adapters import read
from seqloom.streaming import windows as win


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def join_inner_star(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(own.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance")), 2)


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left_count(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").join(read(spark, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT coalesce(c.k, s.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM c FULL JOIN s ON c.k = s.k")
def join_full_outer(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    s = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "k", "full_outer").select("k", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT a.event_id AS event_id, b.event_id AS near FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts")
def join_range_interval(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    a = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("t"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("near"), F.col("ts").cast("timestamp").alias("u"))
    return rel.interval_join(a, b, "user_id", "t", "u", 3600).select("event_id", "near")


@query("SELECT a.event_id, b.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return rel.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", "event_id", "last_view").select("event_id", "last_view")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def setop_union(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def setop_intersect(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "lineitem")
    return own.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(own.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def setop_except_all(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "orders")
    return own.select(F.col("o_custkey").alias("k")).exceptAll(own.where("o_orderstatus = 'F'").select("o_custkey"))


_AGG = "count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem"


@query(f"SELECT l_returnflag, l_linestatus, {_AGG} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_flags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")), 2)


@query(f"SELECT l_returnflag, l_linestatus, {_AGG} GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")), 2)


@query(f"SELECT l_returnflag, l_linestatus, {_AGG} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets_flags(spark: SparkSession, d: str) -> DataFrame:
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], []]
    return rounded(read(spark, d, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")), 2)


@query("SELECT o_orderstatus, round(sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%'), 2) AS p1, round(sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '2%'), 2) AS p2 FROM orders GROUP BY ALL")
def pivot_priority(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "orders").withColumn("p", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    return rounded(own.groupBy("o_orderstatus").pivot("p", ["p1", "p2"]).agg(F.sum("o_totalprice")), 2)


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER w AS nt, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def window_ranks(spark: SparkSession, d: str) -> DataFrame:
    w, p = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    own = read(spark, d, "orders")
    return own.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(3).over(w).alias("nt"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"))


@query("SELECT event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = read(spark, d, "events").select("event_id", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.avg("value").over(w.rowsBetween(-2, 2)).alias("moving"))
    return rounded(own, 4)


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_k_customers(spark: SparkSession, d: str) -> DataFrame:
    return rel.top_k(read(spark, d, "customer"), 3, ["c_nationkey"], F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_limit_orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, round(median(p_retailprice), 2) AS median FROM part GROUP BY p_brand")
def distinct_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(read(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.count_distinct("p_size").alias("sizes"), F.percentile("p_retailprice", 0.5).alias("median")), 2)


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'2001-09-02'")
    out = own.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))
    return out


_HOUR = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query(_HOUR)
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    own = win.tumbling(win.timed(read(spark, d, "events"), "ts"), "ts", "1 hour", "event_type")
    return rounded(own.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query(_HOUR)
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream of files, drained in complete mode."""
    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    own = win.drained(spark, win.tumbling(win.timed(stream, "ts"), "ts", "1 hour", "event_type"))
    return rounded(own.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query("SELECT s AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    own = win.sliding(win.timed(read(spark, d, "events"), "ts"), "ts", "2 hours", "1 hour")
    return rounded(own.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", user_id, count(*) AS n FROM y GROUP BY user_id, s")
def window_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = win.sessions(win.timed(read(spark, d, "events"), "ts"), "ts", "6 hours", "user_id")
    return own.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@query("SELECT s AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    own = win.drained(spark, win.sliding(win.timed(_events(spark, d), "ts"), "ts", "2 hours", "1 hour"))
    return rounded(own.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", user_id, count(*) AS n FROM y GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = win.drained(spark, win.sessions(win.timed(_events(spark, d), "ts"), "ts", "6 hours", "user_id"))
    return own.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query(f"SELECT * FROM ({_HOUR}) WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Append mode: the windows that the watermark, ten minutes behind the last event, has closed."""
    own = win.drained(spark, win.tumbling(win.timed(_events(spark, d), "ts"), "ts", "1 hour", "event_type"), "append")
    return rounded(own.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY (o_orderdate::DATE - DATE '1990-01-01') RANGE BETWEEN 90 PRECEDING AND CURRENT ROW), 2) AS recent FROM orders")
def window_range(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    own = Window.partitionBy("o_custkey").orderBy(day).rangeBetween(-90, 0)
    return read(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(own), 2).alias("recent"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_levels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(read(spark, d, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "orders")
    part = lambda s: own.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return part("O").subtract(part("F"))
