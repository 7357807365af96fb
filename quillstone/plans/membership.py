"""Queries of membership, sessions and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import membership as op
from quillstone.operators import security
from quillstone.plans.registry import fold_sql, query
from quillstone.session import read_table

TARGET = "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'draining' WHEN 'error' THEN 'unreachable' WHEN 'signup' THEN 'joining' ELSE 'terminated' END"
LEGAL_SQL = ", ".join(f"'{a}>{b}'" for a, following in op.LEGAL.items() for b in following)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(TARGET).alias("target"))


T11_SQL = fold_sql(
    f"SELECT event_id, user_id, {TARGET} AS target FROM events WHERE {TARGET} <> 'terminated' OR event_id % 20 = 0",
    "user_id",
    "event_id",
    {
        "state": ("'joining'", f"CASE WHEN f.state || '>' || s.target IN ({LEGAL_SQL}) THEN s.target ELSE f.state END"),
        "result": ("''", f"CASE WHEN s.target = f.state THEN 'same' WHEN f.state || '>' || s.target IN ({LEGAL_SQL}) THEN 'ok' ELSE 'illegal' END"),
    },
    "user_id, event_id, state, result",
)


@query("t11_membership_machine", T11_SQL)
def t11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.membership(_targets(spark, sf_dir).filter("target <> 'terminated' OR event_id % 20 = 0"), "user_id", "event_id", "target")


@query(
    "p32_transition_legality",
    f"""WITH t AS (SELECT event_id, user_id, {TARGET} AS target FROM events),
    b AS (SELECT *, lag(target, 1, 'joining') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM t)
    SELECT event_id, before || '>' || target IN ({LEGAL_SQL}) AS legal FROM b""",
)
def p32(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("target", 1, "joining").over(Window.partitionBy("user_id").orderBy("event_id"))
    return _targets(spark, sf_dir).withColumn("before", before).select("event_id", op.is_legal(F.col("before"), F.col("target")).alias("legal"))


@query("p31_warmup", f"SELECT event_id, {TARGET} = 'joining' AND TIMESTAMP '2024-01-20 00:00:00' < ts + INTERVAL 5 DAY AS warm FROM events")
def p31(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return _targets(spark, sf_dir).select("event_id", op.in_warmup(F.col("target"), F.col("ts"), now, 5 * 86_400).alias("warm"))


@query(
    "w9_debounce",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS end_us, count(*) AS changes FROM s GROUP BY user_id, n""",
)
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.bursts(_targets(spark, sf_dir), ["user_id"], "ts", "2 hours")
    return found.select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("end_us"), "changes")


@query("s37_lease_ttl", "SELECT user_id, max(ts) AS last, max(ts) + INTERVAL 3 HOUR >= TIMESTAMP '2024-01-29 20:00:00' AS alive FROM events GROUP BY user_id")
def s37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.leases(read_table(spark, sf_dir, "events"), "user_id", "ts", F.lit("2024-01-29 20:00:00").cast("timestamp"), 3 * 3600)


@query("s34_heartbeats", "SELECT user_id, max(ts) AS last, count(*) AS beats FROM events WHERE event_type <> 'error' GROUP BY user_id")
def s34(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = read_table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return beats.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("beats"))


SOURCE = "CASE event_type WHEN 'signup' THEN 'view' WHEN 'error' THEN 'view_delete' ELSE 'node' END"


@query(
    "t18_directory_source",
    f"""WITH k AS (SELECT event_id, user_id, {SOURCE} AS kind FROM events),
    l AS (SELECT *, last_value(CASE kind WHEN 'view' THEN true WHEN 'view_delete' THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS live FROM k)
    SELECT event_id FROM l WHERE kind = 'node' AND NOT coalesce(live, false)""",
)
def t18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(SOURCE).alias("kind"))
    return op.directory_source(rows, "user_id", ["event_id"]).select("event_id")


@query(
    "c7_view_publish",
    """WITH n AS (SELECT n_regionkey AS cluster, n_name AS id, CASE WHEN n_nationkey % 6 = 0 THEN 'draining' ELSE 'active' END AS state FROM nation)
    SELECT cluster, count(*)::INT AS n, string_agg(id || '=' || state, ',' ORDER BY id) AS nodes FROM n GROUP BY cluster""",
)
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("n_nationkey") % 6 == 0, "draining").otherwise("active")
    nodes = read_table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("id"), state.alias("state"))
    view = op.publish_view(nodes, "cluster")
    return view.select("cluster", "n", F.array_join(F.transform("nodes", lambda x: F.concat_ws("=", x["id"], x["state"])), ",").alias("nodes"))


@query("r3_sorted_nodes", "SELECT row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS position, n_regionkey, n_name FROM nation")
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).alias("position")
    return read_table(spark, sf_dir, "nation").select(order, "n_regionkey", "n_name")


@query("c1_members", "SELECT n_name AS id, n_regionkey AS cluster FROM nation ORDER BY n_name")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("cluster")).orderBy("id")


@query("a13_member_count", "SELECT CASE WHEN s_acctbal < 0 THEN 'draining' ELSE 'active' END AS state, count(*) AS members FROM supplier GROUP BY 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("s_acctbal") < 0, "draining").otherwise("active").alias("state")
    return read_table(spark, sf_dir, "supplier").groupBy(state).agg(F.count("*").alias("members"))


@query("c4_quota_lookup", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey = 42")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").filter("c_custkey = 42").select("c_custkey", "c_acctbal")


@query("c5_drain_undrain", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id) SELECT user_id FROM l WHERE last = 'click'")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = read_table(spark, sf_dir, "events").filter("event_type IN ('click', 'error')")
    return ops.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).filter("last = 'click'").select("user_id")


@query("p25_trace_filter", "SELECT event_id, md5(user_id::VARCHAR) AS prefix FROM events WHERE starts_with(md5(user_id::VARCHAR), 'a')")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.md5(F.col("user_id").cast("string")).alias("prefix"))
    return rows.filter(F.startswith("prefix", F.lit("a")))


@query("c6_trace", "SELECT event_id, event_type, user_id FROM events WHERE user_id = 7 AND event_type IN ('view', 'error')")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").filter("user_id = 7 AND event_type IN ('view', 'error')").select("event_id", "event_type", "user_id")


LIFE = "CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'finish' WHEN 'purchase' THEN 'pop' ELSE 'cancel' END"


@query(
    "t15_async_lifecycle",
    f"""WITH o AS (SELECT user_id * 100 + event_id % 37 AS request, event_id, {LIFE} AS op FROM events),
    g AS (SELECT request, arg_max(op, event_id) AS op, count(*) FILTER (op = 'start') AS starts FROM o GROUP BY request)
    SELECT request, CASE WHEN starts = 0 THEN 'unknown' WHEN op = 'start' THEN 'running' WHEN op = 'finish' THEN 'finished' WHEN op = 'pop' THEN 'taken' ELSE 'cancelled' END AS state, starts FROM g""",
)
def t15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 37).alias("request"), "event_id", F.expr(LIFE).alias("op"))
    return op.lifecycle(rows, "request", ["event_id"])


LAYERS_SQL = """p AS (SELECT conv_id, turn % 3 AS layer, turn, CASE WHEN turn = 5 THEN '' ELSE md5(text) END AS blob FROM conversations),
    l AS (SELECT conv_id, layer, arg_max(blob, turn) AS b FROM p GROUP BY ALL)"""


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = F.when(F.col("turn") == 5, "").otherwise(F.md5("text")).alias("blob")
    parts = read_table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 3).alias("layer"), "turn", blob)
    return op.concat_layers(parts, "conv_id", "layer", ["turn"], "blob")


@query("a22_layer_concat", f"WITH {LAYERS_SQL} SELECT conv_id, count(*)::INT AS layers, string_agg(b, '' ORDER BY layer) AS joined FROM l WHERE b <> '' GROUP BY conv_id")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir)


@query("t16_layer_accumulate", f"WITH {LAYERS_SQL} SELECT conv_id, count(*)::INT AS layers FROM l WHERE b <> '' GROUP BY conv_id HAVING count(*) = 3")
def t16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).filter("layers = 3").select("conv_id", "layers")


@query(
    "u2_layer_order",
    """WITH r AS (SELECT n_name, n_nationkey AS ordinal FROM nation WHERE n_regionkey <> 1), p AS (SELECT DISTINCT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0)
    SELECT n_name AS layer, row_number() OVER (ORDER BY ordinal NULLS LAST, n_name) AS position FROM p LEFT JOIN r USING (n_name)""",
)
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("layer"), F.col("n_nationkey").alias("ordinal"), "n_regionkey")
    used = read_table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("ordinal"))
    return op.layer_order(nation.filter("n_regionkey <> 1"), nation.join(used, "ordinal"), "layer")


@query("j11_handle_join", "SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    handles = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    owners = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return handles.join(owners, "l_orderkey")


@query("j12_stored_bytes", "SELECT c.conv_id, c.turn, d.n_chars FROM conversations c JOIN documents d ON d.doc_id = c.conv_id")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), "n_chars")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn").join(stored, "conv_id")


@query("t7_watchers", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events WHERE event_id % 9 <> 4 GROUP BY user_id) SELECT c_custkey, last FROM customer LEFT JOIN l ON user_id = c_custkey")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "events").filter("event_id % 9 <> 4")  # bodies that can't be read leave the last good one
    last = good.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", "event_id").alias("last"))
    return read_table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")


@query("s29_registry_prefix", "SELECT '/nodes/' || n_regionkey || '/' || n_name AS key, n_nationkey AS value FROM nation WHERE n_regionkey = 2")
def s29(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("/", F.lit("/nodes"), "n_regionkey", "n_name").alias("key")
    return read_table(spark, sf_dir, "nation").select(key, F.col("n_nationkey").alias("value")).filter(F.startswith("key", F.lit("/nodes/2/")))


@query("s33_span_export", """SELECT '{"span_id":"' || md5(event_id::VARCHAR) || '","name":"' || event_type || '"}' AS span FROM events""")
def s33(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.md5(F.col("event_id").cast("string")).alias("span_id"), F.col("event_type").alias("name"))
    return security.audit_lines(rows, ["span_id", "name"]).withColumnRenamed("line", "span")
