"""Queries of quotas and priorities: customers are tenants, orders and events are requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import epoch_millis
from quillstone.operators import qos as op
from quillstone.plans.registry import fold_sql, query
from quillstone.session import read_table


@query("f17_quota_inflation", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN floor(c_custkey * 7 * 1.5)::BIGINT ELSE c_custkey * 7 END AS capacity FROM customer")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select("c_custkey", op.inflated(key * 7, key % 3 == 0).alias("capacity"))


@query(
    "f18_reservation_split",
    """WITH s AS (SELECT c_custkey, c_custkey % 4 * 10 AS a, c_custkey % 2 * 75 AS b, c_custkey % 4 * 5 AS c FROM customer),
    w AS (SELECT *, CASE WHEN a + b + c = 0 THEN 100 ELSE a + b + c END AS whole FROM s)
    SELECT c_custkey, 1000 * a // whole AS p0, 1000 * b // whole AS p1, 1000 * c // whole AS p2 FROM w""",
)
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    parts = op.reservations(F.lit(1000), [key % 4 * 10, key % 2 * 75, key % 4 * 5])
    return read_table(spark, sf_dir, "customer").select("c_custkey", *[p.alias(f"p{i}") for i, p in enumerate(parts)])


MOVES = "CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN -9 ELSE 2 END"


@query(
    "a12_capacity_used",
    f"""WITH m AS (SELECT event_id, user_id, sum({MOVES}) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
    SELECT event_id, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY event_id)) AS used FROM m""",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(MOVES).alias("delta"))
    return op.capacity_used(moves, "user_id", ["event_id"], "delta").select("event_id", "used")


CLASS = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 1 ELSE 2 END"
ROBIN_SQL = f"""w AS (SELECT o_orderkey, o_orderstatus, {CLASS} AS class, o_custkey FROM orders),
    t AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, class, o_custkey ORDER BY o_orderkey) AS turn, min(o_orderkey) OVER (PARTITION BY o_orderstatus, class, o_custkey) AS first FROM w),
    p AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY class, turn, first) AS position FROM t)"""


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.expr(CLASS).alias("class"), "o_custkey")


@query("w7_tenant_round_robin", f"WITH {ROBIN_SQL} SELECT o_orderkey, position FROM p")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.round_robin(_work(spark, sf_dir), ["o_orderstatus"], "class", "o_custkey", "o_orderkey").select("o_orderkey", "position")


@query("r6_priority_order", f"WITH {ROBIN_SQL} SELECT o_orderstatus, class, min(position) AS first, max(position) AS last FROM p GROUP BY ALL")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = op.round_robin(_work(spark, sf_dir), ["o_orderstatus"], "class", "o_custkey", "o_orderkey")
    return placed.groupBy("o_orderstatus", "class").agg(F.min("position").alias("first"), F.max("position").alias("last"))


@query("a19_scheduler_stats", f"SELECT {CLASS} AS class, count(*) AS depth, sum(o_orderkey % 4096)::BIGINT AS bytes, count(DISTINCT o_custkey) AS tenants FROM orders GROUP BY 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.class_stats(_work(spark, sf_dir).withColumn("bytes", F.col("o_orderkey") % 4096), "class", "o_custkey", "bytes")


@query(
    "w6_aligned_window",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch_ms(ts) // 1000 // 3600 ORDER BY ts, event_id) <= 2 AS admitted FROM events",
)
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.call_function("div", epoch_millis(F.col("ts")), F.lit(3_600_000)) * 1000  # hours stand for seconds
    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("tenant"), "ts", hours.alias("ts_ms"))
    return op.aligned_admission(rows, 2, ["ts", "event_id"]).select("event_id", "admitted")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    release = F.when(F.col("event_type") == "purchase", F.col("event_id") % 64 + 1).otherwise(0)
    return events.select(
        F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), epoch_millis(F.col("ts")).alias("ts_ms"),
        (F.col("event_id") % 64).alias("bytes"), F.lit(1).alias("requests"), (F.col("event_id") % 900).alias("bandwidth"), release.alias("released"),
    )


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 9").select(
        key.alias("tenant"), (key % 9 * 200).alias("capacity"), (key % 5).alias("qps"), (key % 4 * 1000).alias("bps"), (key % 2 == 1).alias("inflated")
    )


_CAP, _QPS, _BPS = (f"(floor(s.{c} * CASE WHEN s.inflated THEN 1.5 ELSE 1 END))::BIGINT" for c in ("capacity", "qps", "bps"))
_ROLL = "(f.start IS NULL OR s.ts_ms - f.start >= 21600000)"
_REQS, _BAND = (f"(CASE WHEN {_ROLL} THEN 0 ELSE f.{c} END)" for c in ("requests", "bandwidth"))
_FULL = f"(CASE WHEN {_CAP} > 0 THEN f.used + s.bytes > {_CAP} ELSE s.bytes > 0 END)"
_RESULT = f"""(CASE WHEN s.released > 0 THEN 'released' WHEN s.capacity IS NULL THEN 'unknown_tenant' WHEN {_FULL} THEN 'capacity'
    WHEN {_QPS} > 0 AND {_REQS} + 1 > {_QPS} THEN 'qps' WHEN {_BPS} > 0 AND {_BAND} + s.bandwidth > {_BPS} THEN 'bandwidth' ELSE 'ok' END)"""
_ASKED = f"s.released = 0 AND s.capacity IS NOT NULL AND NOT {_FULL}"
ADMIT_SQL = fold_sql(
    """SELECT user_id AS tenant, event_id AS seq, epoch_ms(ts) AS ts_ms, event_id % 64 AS bytes, event_id % 900 AS bandwidth,
    CASE WHEN event_type = 'purchase' THEN event_id % 64 + 1 ELSE 0 END AS released, c_custkey % 9 * 200 AS capacity, c_custkey % 5 AS qps, c_custkey % 4 * 1000 AS bps,
    c_custkey % 2 = 1 AS inflated FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 9) ON c_custkey = user_id""",
    "tenant",
    "seq",
    {
        "used": ("0::BIGINT", f"CASE WHEN s.released > 0 THEN f.used - least(s.released, f.used) WHEN {_RESULT} = 'ok' AND {_CAP} > 0 THEN f.used + s.bytes ELSE f.used END"),
        "start": ("NULL::BIGINT", f"CASE WHEN {_ASKED} AND {_ROLL} THEN s.ts_ms ELSE f.start END"),
        "requests": ("0::BIGINT", f"CASE WHEN {_ASKED} THEN {_REQS} + CASE WHEN {_RESULT} = 'ok' THEN 1 ELSE 0 END ELSE f.requests END"),
        "bandwidth": ("0::BIGINT", f"CASE WHEN {_ASKED} THEN {_BAND} + CASE WHEN {_RESULT} = 'ok' THEN s.bandwidth ELSE 0 END ELSE f.bandwidth END"),
        "result": ("''", _RESULT),
    },
    "tenant, seq, result, used",
)


@query("t8_quota_admission", ADMIT_SQL)
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.admit(_requests(spark, sf_dir), _limits(spark, sf_dir), 6 * 3_600_000)


_LOAD_CLASS = "CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END"


@query(
    "t10_class_load",
    f"""WITH b AS (SELECT user_id % 5 AS tenant, {_LOAD_CLASS} AS class, epoch_ms(ts) // 3600000 AS hour,
                      sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE event_id % 120 + 1 END)::BIGINT AS submitted, sum(CASE WHEN event_type = 'purchase' THEN event_id % 120 + 1 ELSE 0 END)::BIGINT AS finished
               FROM events GROUP BY ALL),
    s AS (SELECT *, sum(submitted - finished) OVER w AS level FROM b WINDOW w AS (PARTITION BY tenant, class ORDER BY hour))
    SELECT tenant, class, hour, submitted, finished, (level - least(0, min(level) OVER (PARTITION BY tenant, class ORDER BY hour)))::BIGINT AS in_flight FROM s""",
)
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.call_function("div", epoch_millis(F.col("ts")), F.lit(3_600_000)).alias("hour")
    work = read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("tenant"), F.expr(_LOAD_CLASS).alias("class"), hour, (F.col("event_id") % 120 + 1).alias("bytes"), (F.col("event_type") == "purchase").alias("done")
    )
    return op.class_load(work, ["tenant", "class"], "hour", "bytes", "done")


def _backlog_sql(drained: str, capacity: int) -> str:
    """The depth by its recursion: what was left, but at least nothing, and the arrival."""
    source = f"SELECT user_id, event_id AS seq, {drained} AS drained FROM events"
    state = {"depth": ("0::BIGINT", "greatest(0, f.depth - s.drained) + 1")}
    return fold_sql(source, "user_id", "seq", state, f"user_id, seq, depth, depth > {capacity} AS over")


_SLOW, _BURSTS = "CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END", "CASE WHEN event_id % 20 = 0 THEN 15 ELSE 0 END"


def _backlog(spark: SparkSession, sf_dir: str, drained: str, capacity: int) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.expr(drained).cast("bigint").alias("drained"))
    return op.backlog(rows, "user_id", ["seq"], capacity).select("user_id", "seq", "depth", "over")


@query("t9_subscriber_backlog", _backlog_sql(_SLOW, 8))
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backlog(spark, sf_dir, _SLOW, 8)


@query("t14_audit_backlog", _backlog_sql(_BURSTS, 10))
def t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backlog(spark, sf_dir, _BURSTS, 10)
