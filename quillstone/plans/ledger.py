"""Queries of logs and tables: events are the log, users the keys or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import ledger as op
from quillstone.plans.registry import query
from quillstone.session import read_table

OP = "CASE event_type WHEN 'error' THEN 'REMOVE' ELSE 'INSERT' END"
LOG_SQL = f"log AS (SELECT event_id, ts, user_id, event_type, {OP} AS op, md5(props) AS blob FROM events)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    return rows.select("event_id", "ts", "user_id", "event_type", F.expr(OP).alias("op"), F.md5("props").alias("blob"))


@query(
    "s1_reserve",
    """WITH r AS (SELECT o_orderkey, o_orderpriority AS pool, o_orderkey % 120 - 5 AS bytes FROM orders),
    u AS (SELECT *, sum(CASE WHEN bytes > 0 AND bytes <= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY pool ORDER BY o_orderkey) AS used FROM r)
    SELECT o_orderkey, CASE WHEN bytes <= 0 THEN 'INVAL' WHEN bytes > 100 OR used > 400 THEN 'NOMEM' ELSE 'OK' END AS status FROM u""",
)
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.col("o_orderpriority").alias("pool"), (F.col("o_orderkey") % 120 - 5).alias("bytes"))
    return op.reserve(rows, ["o_orderkey"], "bytes", 400, 100, ["pool"]).select("o_orderkey", "status")


MARKS_SQL = "SELECT event_id, max(event_id * 7919 % 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS watermark FROM events"


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.col("event_id") * 7919 % 1000).alias("mark"))
    return op.watermarks(pubs, ["user_id"], ["ts", "event_id"], "mark")


@query("s2_publish_watermark", MARKS_SQL)
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).select("event_id", "watermark")


@query("w2_running_watermark", f"WITH m AS ({MARKS_SQL}) SELECT user_id, max(watermark) AS watermark FROM m JOIN events USING (event_id) GROUP BY user_id")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir).groupBy("user_id").agg(F.max("watermark").alias("watermark"))


@query("w1_epoch_stamp", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stamp_epochs(read_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "epoch")


COMMIT = "event_id % 5 AS depth, event_id % 7 * 64 AS watermark, event_id % 11 <> 0 AS store"
COMMIT_SQL = f"""h AS (SELECT event_id, user_id, {COMMIT} FROM events),
    c AS (SELECT *, CASE WHEN depth <= 0 OR watermark <= 0 THEN 'INVAL' WHEN NOT store THEN 'SKIPPED' ELSE 'OK' END AS status FROM h)"""


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").selectExpr("event_id", "user_id", *COMMIT.split(", "))
    return op.commit(rows, "watermark", "depth", F.col("store"))


@query("s4_seal_commit", f"WITH {COMMIT_SQL} SELECT event_id, status, CASE WHEN status = 'OK' THEN watermark ELSE 0 END AS staged FROM c")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).select("event_id", "status", "staged")


@query(
    "s6_commit_events",
    f"WITH {COMMIT_SQL} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM c WHERE status = 'OK'",
)
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _commits(spark, sf_dir).filter("status = 'OK'")
    return op.stamp_epochs(done, ["user_id"], ["event_id"]).select("event_id", "epoch")


@query("s7_latest_per_key", f"WITH {LOG_SQL} SELECT user_id, event_type, arg_max(blob, event_id) AS blob FROM log GROUP BY ALL")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latest(log(spark, sf_dir), ["user_id", "event_type"], ["event_id"], ["blob"])


@query("s8_table_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("s9_quota_state", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS writes FROM events GROUP BY user_id")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    writes = rows.groupBy("user_id").agg(F.count("*").alias("writes"))
    return op.latest(rows, ["user_id"], ["ts", "event_id"], ["event_id"]).join(writes, "user_id")


@query("s11_config_kv", "SELECT event_type || '/' || user_id AS key, arg_max(md5(props), event_id) AS value FROM events GROUP BY 1")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", "user_id").alias("key"), F.md5("props").alias("value"), "event_id")
    return op.latest(rows, ["key"], ["event_id"], ["value"])


VALID_SQL = f"""{LOG_SQL}, v AS (SELECT *, sum(CASE WHEN event_id % 701 = 700 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM log),
    good AS (SELECT * FROM v WHERE bad = 0)"""


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.valid_prefix(log(spark, sf_dir), ["user_id"], ["event_id"], F.col("event_id") % 701 != 700)


@query(
    "s12_log_replay",
    f"""WITH {VALID_SQL}, l AS (SELECT user_id, event_type, arg_max(op, event_id) AS op, arg_max(blob, event_id) AS blob FROM good GROUP BY ALL)
    SELECT user_id, event_type, blob FROM l WHERE op <> 'REMOVE'""",
)
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.replay(_valid(spark, sf_dir), ["user_id", "event_type"], ["event_id"], "op", ["blob"])


@query(
    "s13_checkpoint",
    f"""WITH {LOG_SQL}, l AS (SELECT user_id, arg_max(op, event_id) AS op, arg_max(blob, event_id) AS blob FROM log GROUP BY ALL)
    SELECT user_id, blob FROM l WHERE op <> 'REMOVE'""",
)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot, rest = op.checkpoint(log(spark, sf_dir), ["user_id"], "event_id", "op", ["blob"], 4000)
    return op.replay(snapshot.unionByName(rest, allowMissingColumns=True), ["user_id"], ["event_id"], "op", ["blob"])


@query(
    "s14_snapshot_checksum",
    "SELECT event_type, count(*) AS n, sum(('0x' || substr(sha256(event_id || '|' || user_id), 1, 12))::BIGINT)::BIGINT AS checksum FROM events GROUP BY event_type",
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.table_checksum(read_table(spark, sf_dir, "events"), ["event_id", "user_id"], ["event_type"])


@query("s15_state_log", f"WITH {VALID_SQL} SELECT user_id, arg_max(blob, event_id) AS blob FROM good GROUP BY user_id")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latest(_valid(spark, sf_dir), ["user_id"], ["event_id"], ["blob"])


GET_SQL = f"""{LOG_SQL}, cached AS (SELECT user_id, arg_max(blob, event_id) AS blob FROM log WHERE event_type = 'view' AND user_id % 3 = 0 GROUP BY user_id),
    logged AS (SELECT user_id, arg_max(blob, event_id) AS blob FROM log WHERE event_type = 'click' AND user_id % 5 <> 0 GROUP BY user_id)"""


@query(
    "j16_state_get",
    f"""WITH {GET_SQL} SELECT c_custkey AS user_id, coalesce(c.blob, l.blob) AS blob,
    CASE WHEN c.blob IS NOT NULL THEN 'cache' WHEN l.blob IS NOT NULL THEN 'log' ELSE 'NOT_FOUND' END AS source
    FROM customer LEFT JOIN cached c ON c.user_id = c_custkey LEFT JOIN logged l ON l.user_id = c_custkey""",
)
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    cache = op.latest(rows.filter("event_type = 'view' AND user_id % 3 = 0"), ["user_id"], ["event_id"], ["blob"])
    puts = rows.filter("event_type = 'click' AND user_id % 5 <> 0")
    keys = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return op.state_get(keys, "user_id", cache, puts, ["event_id"], "blob")


@query("s36_state_put", f"WITH {LOG_SQL} SELECT user_id, count(*) AS puts, arg_max(blob, event_id) AS blob FROM log GROUP BY user_id")
def s36(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return op.latest(rows, ["user_id"], ["event_id"], ["blob"]).join(rows.groupBy("user_id").agg(F.count("*").alias("puts")), "user_id")


@query(
    "s40_compare_and_put",
    """WITH t AS (SELECT user_id, count(*) AS revision FROM events WHERE user_id % 2 = 0 GROUP BY user_id),
    p AS (SELECT DISTINCT user_id, user_id % 3 * 66 AS expected FROM events)
    SELECT p.user_id, p.expected, coalesce(t.revision, 0) = p.expected AS applied FROM p LEFT JOIN t USING (user_id)""",
)
def s40(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    table = events.filter("user_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("revision"))
    puts = events.select("user_id", (F.col("user_id") % 3 * 66).alias("expected")).distinct()
    return op.compare_and_put(table, puts, "user_id")


@query("u4_membership_apply", f"WITH {LOG_SQL}, l AS (SELECT user_id, arg_max(op, (ts, event_id)) AS op, max(ts) AS ts FROM log GROUP BY ALL) SELECT user_id, ts FROM l WHERE op <> 'REMOVE'")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.replay(log(spark, sf_dir), ["user_id"], ["ts", "event_id"], "op", ["ts"])


@query(
    "t19_peer_sketches",
    "WITH l AS (SELECT s_nationkey AS node, arg_max(s_suppkey, s_suppkey) AS sketch, arg_max(s_acctbal, s_suppkey) AS b FROM supplier GROUP BY ALL) SELECT node, sketch FROM l WHERE b >= 0",
)
def t19(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("s_acctbal") < 0, "DELETE").otherwise("PUT")
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node"), F.col("s_suppkey").alias("sketch"), kind.alias("op"))
    return op.replay(rows, ["node"], ["sketch"], "op", ["sketch"])


DELTA = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END"


@query("t3_refcount", f"SELECT event_id, 1 + sum({DELTA}) OVER (PARTITION BY user_id ORDER BY event_id) AS refcount FROM events")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.references(read_table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.expr(DELTA)).select("event_id", "refcount")


@query("t17_reclamation", "SELECT event_id FROM events WHERE event_type = 'error' AND event_id <= (SELECT min(event_id + 3000) FROM events WHERE event_type = 'signup')")
def t17(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    readers = events.filter("event_type = 'signup'").select((F.col("event_id") + 3000).alias("witness"))
    return op.reclaimable(events.filter("event_type = 'error'").select("event_id"), readers, "event_id", "witness")


@query("t4_reservation_ttl", "SELECT event_id FROM events WHERE event_type = 'view' AND ts + INTERVAL 300 SECOND < TIMESTAMP '2024-01-15 00:00:00'")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = read_table(spark, sf_dir, "events").filter("event_type = 'view'").select("event_id", "ts")
    return op.expired(views, "ts", F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


EVENT = "CASE event_type WHEN 'error' THEN 'EVICT' ELSE 'ADD' END AS type, event_id % 5 + 1 AS tier, (event_id * 37) % 2003 AS epoch"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr("event_id", "user_id", *[e.strip() for e in EVENT.split(", ")])


@query("p10_is_warm", f"SELECT event_id FROM (SELECT event_id, {EVENT} FROM events) WHERE type = 'ADD' AND tier BETWEEN 1 AND 3")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed(spark, sf_dir).filter(op.is_warm(F.col("type"), F.col("tier"), 3)).select("event_id")


@query(
    "p11_cursor",
    f"""WITH e AS (SELECT event_id, user_id, {EVENT} FROM events), b AS (SELECT *, coalesce(max(epoch) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e) SELECT event_id, epoch FROM b WHERE epoch > before""",
)
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.after_cursor(_feed(spark, sf_dir), ["user_id"], ["event_id"], "epoch").select("event_id", "epoch")


@query(
    "t6_adopt_cluster_view",
    """WITH v AS (SELECT event_id, user_id, event_id // 500 % 2 AS leader, (event_id * 37) % 2003 AS epoch FROM events),
    f AS (SELECT *, CASE WHEN lag(leader) OVER w IS NULL OR leader <> lag(leader) OVER w THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    t AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS term FROM f),
    b AS (SELECT *, max(epoch) OVER (PARTITION BY user_id, term ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
    SELECT event_id, leader, epoch FROM b WHERE before IS NULL OR epoch > before""",
)
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = read_table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_id div 500 % 2 AS leader", "(event_id * 37) % 2003 AS epoch")
    return op.adopt_views(views, ["user_id"], ["event_id"]).select("event_id", "leader", "epoch")
