"""Queries of routing: users are keys, nations and suppliers are nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import routing as op
from quillstone.plans.registry import query
from quillstone.session import read_table

HASH = "('0x' || substr(md5(n_name || '|' || user_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
SCORES = f"scores AS (SELECT user_id, n_name AS node, {HASH} * (1.0::DOUBLE + n_regionkey) AS score FROM (SELECT DISTINCT user_id FROM events), nation)"
BEST = "best AS (SELECT user_id, node, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, node) AS rank FROM scores)"
PUTS = "puts AS (SELECT user_id, ts, 'n' || (event_id % 7) AS node FROM events WHERE event_type = 'view')"
CACHE = f"""{PUTS}, cache AS (
    SELECT l.event_id, l.user_id, l.ts, (SELECT CASE WHEN max(p.ts) + INTERVAL 6 HOUR >= l.ts THEN max_by(p.node, (p.ts, p.node)) END
        FROM puts p WHERE p.user_id = l.user_id AND p.ts <= l.ts) AS cached FROM events l WHERE l.event_type = 'click')"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("user_id").distinct()


def nodes(spark: SparkSession, sf_dir: str):
    weighted = read_table(spark, sf_dir, "nation").select("n_name", (F.col("n_regionkey") + 1.0).alias("w"))
    return op.node_array(weighted, "n_name", "w")


@query("r1_hrw_primary", f"WITH {SCORES}, {BEST} SELECT user_id, node FROM best WHERE rank = 1")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hrw_primary(users(spark, sf_dir), F.col("user_id").cast("string"), nodes(spark, sf_dir))


@query("r2_hrw_top_k", f"WITH {SCORES}, {BEST} SELECT user_id, rank, node FROM best WHERE rank <= 3")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hrw_top_k(users(spark, sf_dir), F.col("user_id").cast("string"), nodes(spark, sf_dir), 3)


@query(
    "x2_hrw_overlap",
    f"""WITH {SCORES}, o AS (SELECT user_id, node, score * (1 + 0.2::DOUBLE * (length(node) % 3)) AS score FROM scores),
    b AS (SELECT user_id, node, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, node) AS rank FROM o)
    SELECT user_id, node FROM b WHERE rank = 1""",
)
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("user_id").cast("string")
    return op.hrw_primary(users(spark, sf_dir), key, nodes(spark, sf_dir), overlap=lambda node: F.length(node) % 3)


BODY = """'{"id":"' || CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END || '","state":"' ||
 CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'Draining' ELSE 'joining' END || '","weight":' ||
 CASE s_suppkey % 4 WHEN 0 THEN '"x"' WHEN 1 THEN '-1' ELSE '' || (s_suppkey % 5) END || '}'"""


@query(
    "p12_routable_nodes",
    f"""WITH b AS (SELECT ({BODY})::JSON AS j FROM supplier)
    SELECT j->>'id' AS node, CASE WHEN try_cast(j->>'weight' AS DOUBLE) > 0 THEN try_cast(j->>'weight' AS DOUBLE) ELSE 1.0 END AS weight
    FROM b WHERE j->>'id' <> '' AND lower(j->>'state') NOT LIKE '%drain%'""",
)
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = read_table(spark, sf_dir, "supplier").select(F.expr(BODY).alias("body"))
    return op.routable_nodes(bodies, "body")


STATE = "CASE event_type WHEN 'signup' THEN 'joining' WHEN 'error' THEN 'draining' WHEN 'click' THEN 'terminated' ELSE 'active' END"


@query("p30_traffic_weight", f"SELECT event_id, CASE {STATE} WHEN 'joining' THEN 0.1 WHEN 'active' THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM events")
def p30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", op.traffic_weight(F.expr(STATE)).alias("weight"))


@query(
    "j13_drain_overlay",
    "SELECT n_nationkey AS id, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN 'draining' ELSE 'active' END AS state FROM nation",
)
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("active").alias("state"))
    markers = read_table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("id"))
    return op.drain_overlay(members, "id", "state", markers)


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    puts = events.filter("event_type = 'view'").select("user_id", "ts", F.concat(F.lit("n"), F.col("event_id") % 7).alias("node"))
    lookups = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return op.route_cache(lookups, puts, "user_id", "ts", 6 * 3600)


@query("j17_routing_cache", f"WITH {CACHE} SELECT event_id, user_id, cached FROM cache")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir).select("event_id", "user_id", "cached")


MAYBE = "user_id % 4 <> 3"


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.hrw_primary(_cached(spark, sf_dir), F.col("user_id").cast("string"), nodes(spark, sf_dir))
    return rows.withColumnRenamed("node", "resolved")


@query(
    "j18_read_route",
    f"""WITH {SCORES}, {BEST}, {CACHE} SELECT event_id,
    CASE WHEN NOT ({MAYBE}) THEN 'bloom_miss' WHEN cached IS NOT NULL THEN 'cache' WHEN b.node IS NOT NULL THEN 'hrw' ELSE 'miss' END AS source,
    CASE WHEN {MAYBE} THEN coalesce(cached, b.node) END AS node FROM cache c LEFT JOIN best b USING (user_id) WHERE b.rank = 1""",
)
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = op.read_route(_resolved(spark, sf_dir), F.expr(MAYBE), F.col("cached"), F.col("resolved"))
    return routed.select("event_id", "source", "node")


@query(
    "j19_write_route",
    f"""WITH {SCORES}, {BEST}, {CACHE} SELECT event_id, CASE WHEN cached IS NOT NULL THEN 'cache' ELSE 'hrw' END AS source,
    coalesce(cached, b.node) AS node FROM cache c LEFT JOIN best b USING (user_id) WHERE b.rank = 1""",
)
def j19(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = op.write_route(_resolved(spark, sf_dir), F.col("cached"), F.col("resolved"))
    return routed.select("event_id", "source", "node")


@query(
    "j20_lookup_fan_out",
    f"""WITH {SCORES}, {BEST}, peer AS (SELECT user_id, min_by(node, rank) AS peer FROM best
        WHERE rank BETWEEN 2 AND 4 AND (user_id + length(node)) % 3 = 0 GROUP BY user_id)
    SELECT b.user_id, CASE WHEN b.user_id % 2 = 0 THEN 'primary' WHEN peer IS NOT NULL THEN 'peer' ELSE 'miss' END AS source,
           CASE WHEN b.user_id % 2 = 0 THEN b.node ELSE peer END AS node
    FROM best b LEFT JOIN peer USING (user_id) WHERE b.rank = 1""",
)
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = users(spark, sf_dir)
    ranked = op.hrw_top_k(keys, F.col("user_id").cast("string"), nodes(spark, sf_dir), 4)
    local = keys.withColumn("hit", F.col("user_id") % 2 == 0)
    peers = ranked.select("user_id", "node", ((F.col("user_id") + F.length("node")) % 3 == 0).alias("maybe"))
    return op.fan_out(local, ranked, peers, "user_id")


RANKED = """ranked AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY last DESC, user_id) AS rank
    FROM (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY ALL))"""


@query("w8_recency_rank", f"WITH {RANKED} SELECT * FROM ranked")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.recency_rank(read_table(spark, sf_dir, "events"), ["event_type"], "user_id", "ts")


@query("r5_capacity_limit", f"WITH {RANKED} SELECT event_type, user_id, rank FROM ranked WHERE rank <= 40")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.capacity_limit(op.recency_rank(read_table(spark, sf_dir, "events"), ["event_type"], "user_id", "ts"), 40)


@query(
    "a20_cache_stats",
    f"""WITH {CACHE} SELECT (SELECT count(*) FROM puts) AS puts, count(*) FILTER (cached IS NOT NULL) AS hits,
    count(*) FILTER (cached IS NULL) AS misses FROM cache""",
)
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = read_table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "view").alias("puts"))
    seen = _cached(spark, sf_dir).agg(F.count("cached").alias("hits"), F.count_if(F.col("cached").isNull()).alias("misses"))
    return puts.crossJoin(seen)
