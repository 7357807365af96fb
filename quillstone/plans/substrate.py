"""Common relational queries on the star schema: the ground the operators stand on, not features of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.plans.registry import query
from quillstone.session import read_table

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@query(
    "substrate_pricing_summary",
    f"""SELECT l_returnflag, l_linestatus, count(*) AS n, sum({CENTS})::BIGINT AS cents, max(l_quantity) AS most FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.expr(CENTS)).alias("cents"), F.max("l_quantity").alias("most"))


@query(
    "substrate_star_join",
    f"""SELECT r_name, n_name, sum({CENTS})::BIGINT AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY ALL""",
)
def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read_table(spark, sf_dir, name)
    orders = t("orders").filter("o_orderdate >= TIMESTAMP '1995-01-01'").select("o_orderkey", "o_custkey")
    rows = t("lineitem").select("l_orderkey", F.expr(CENTS).alias("c")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.sum("c").alias("cents"))


def _grouped(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    return getattr(rows, how)("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("substrate_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "cube")


@query("substrate_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(spark, sf_dir, "rollup")


@query("substrate_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read_table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("substrate_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(buyers, "c_custkey", "left_anti")


@query("substrate_set_operations", "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name, col: read_table(spark, sf_dir, name).select(F.col(col).alias("k"))
    africa = read_table(spark, sf_dir, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("k"))
    return t("supplier", "s_nationkey").intersect(t("customer", "c_nationkey")).exceptAll(africa)


@query(
    "substrate_top_per_group",
    "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
)
def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("r"))
    return ranked.filter("r <= 3")


@query(
    "substrate_as_of_join",
    """WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT p.event_id, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'view')")
    series = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).over(series)
    return rows.withColumn("last", last).filter("event_type = 'purchase'").select("event_id", F.col("last.event_id").alias("view_id"))


@query("substrate_distinct_counts", "SELECT l_shipdate, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_shipdate")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query("substrate_tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read_table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("day"), "event_type", "n")


@query("substrate_approx_distinct")
def approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
