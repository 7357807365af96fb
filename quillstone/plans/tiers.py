"""Queries of tiers and policies: documents are blobs, spread over tiers by their id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import tiers as op
from quillstone.plans.registry import query
from quillstone.session import read_table

KIND = "CASE doc_id % 4 WHEN 0 THEN 'KV' WHEN 1 THEN 'TOOL_RESULT' WHEN 2 THEN 'MEMORY' ELSE 'EXEC_STATE' END"
TIER_TEST = {"dram": "doc_id % 7 = 0", "nvme": "doc_id % 3 = 0", "cold": "doc_id % 2 = 0"}
FETCH_SQL = f"""fetched AS (SELECT doc_id, CASE WHEN {TIER_TEST['dram']} THEN 'dram' WHEN {TIER_TEST['nvme']} THEN 'nvme' WHEN {TIER_TEST['cold']} THEN 'cold' ELSE 'miss' END AS tier,
    CASE WHEN {' OR '.join(TIER_TEST.values())} THEN md5(text) END AS payload FROM documents)"""


def _tier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter(TIER_TEST[name]).select("doc_id", F.md5("text").alias("payload"))


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read_table(spark, sf_dir, "documents").select("doc_id")
    return op.tiered_fetch(keys, "doc_id", {n: _tier(spark, sf_dir, n) for n in TIER_TEST})


@query("j9_tiered_fetch", f"WITH {FETCH_SQL} SELECT doc_id, tier, payload FROM fetched")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetched(spark, sf_dir)


@query("j9_promotion", f"WITH {FETCH_SQL} SELECT doc_id, payload, 'dram' AS tier FROM fetched WHERE tier IN ('nvme', 'cold')")
def j9_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.promotions(_fetched(spark, sf_dir), "doc_id", "dram")


@query("j10_replica_fetch", "SELECT d.doc_id, d.lang, md5(d.text) AS payload FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id % 7 = 0")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    locators = read_table(spark, sf_dir, "labels").select("doc_id")
    index = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return op.replica_fetch(locators, index, _tier(spark, sf_dir, "dram"), "doc_id")


@query(
    "s35_segments",
    "SELECT doc_id, i AS segment, least(1024, n_chars - i * 1024) AS segment_bytes FROM documents, unnest(range(0, ((n_chars + 1023) // 1024)::BIGINT)) r(i)",
)
def s35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.segments(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 1024).select("doc_id", "segment", "segment_bytes")


@query("s16_cold_path", "SELECT doc_id, substr(md5(text), 1, 2) || '/' || substr(md5(text), 3) || '.kv' AS path FROM documents")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", op.cold_path(F.md5("text")).alias("path"))


@query(
    "s19_slab_put",
    """WITH u AS (SELECT p_partkey, p_brand, p_size, sum(CASE WHEN p_size > 0 AND p_size <= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS used FROM part)
    SELECT p_partkey, CASE WHEN NOT (p_size > 0 AND p_size <= 40) THEN 'reject' WHEN used > 30 THEN 'full' ELSE 'ok' END AS status FROM u""",
)
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return op.slab_status(parts, ["p_partkey"], ["p_brand"], "p_size", 40, 30).select("p_partkey", "status")


DELTA = "CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END"
OCCUPANCY_SQL = f"o AS (SELECT event_id, user_id, sum({DELTA}) OVER (PARTITION BY user_id ORDER BY event_id) AS in_use FROM events)"


def _occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(DELTA).alias("delta"))
    return op.occupancy(ops, ["user_id"], ["event_id"], 64)


@query("s20_pinned_slots", f"WITH {OCCUPANCY_SQL} SELECT event_id, in_use FROM o")
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir).select("event_id", "in_use")


@query("a18_slot_utilization", f"WITH {OCCUPANCY_SQL} SELECT user_id, max(in_use) / 64.0::DOUBLE AS utilization FROM o GROUP BY user_id")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occupancy(spark, sf_dir).groupBy("user_id").agg(F.max("utilization").alias("utilization"))


@query("a16_tier_usage", f"WITH {FETCH_SQL} SELECT tier, lang, count(*) AS entries, sum(n_chars)::BIGINT AS bytes FROM fetched JOIN documents USING (doc_id) GROUP BY tier, lang")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return op.tier_usage(_fetched(spark, sf_dir).join(sizes, "doc_id"), ["tier", "lang"], "n_chars")


STATUS = "CASE event_id % 10 WHEN 7 THEN 'miss' WHEN 9 THEN 'error' ELSE 'ok' END"


@query(
    "s23_tier_counters",
    f"""SELECT event_type AS op, count(*) AS calls, sum(CASE WHEN {STATUS} = 'ok' THEN event_id % 4096 ELSE 0 END)::BIGINT AS bytes,
    count(*) FILTER ({STATUS} = 'miss') AS misses, count(*) FILTER ({STATUS} = 'error') AS errors FROM events GROUP BY event_type""",
)
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), (F.col("event_id") % 4096).alias("bytes"), F.expr(STATUS).alias("status"))
    return op.op_counters(rows, "op", "bytes", "status")


COST = "doc_id % 50 AS fetch_ms, doc_id % 7 * 10 AS recompute_ms, quality = 1 AS idempotent"


@query(
    "p21_should_store_kv",
    f"SELECT doc_id, recompute_ms = 0 OR fetch_ms < recompute_ms AS store FROM (SELECT doc_id, {COST} FROM labels)",
)
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").selectExpr("doc_id", *COST.split(", "))
    return rows.select("doc_id", op.should_store(F.lit("KV"), F.lit(True), F.col("fetch_ms"), F.col("recompute_ms")).alias("store"))


@query(
    "p22_should_store_tool",
    f"SELECT doc_id, CASE WHEN NOT idempotent THEN false ELSE recompute_ms = 0 OR fetch_ms < recompute_ms END AS store FROM (SELECT doc_id, {COST} FROM labels)",
)
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").selectExpr("doc_id", *COST.split(", "))
    return rows.select("doc_id", op.should_store(F.lit("TOOL_RESULT"), F.col("idempotent"), F.col("fetch_ms"), F.col("recompute_ms")).alias("store"))


@query(
    "p23_policies",
    f"""SELECT doc_id, CASE WHEN k = 'EXEC_STATE' THEN 'pinned' ELSE 'evict' END AS eviction, CASE WHEN k IN ('MEMORY', 'EXEC_STATE') THEN 'replay' ELSE 'recompute' END AS on_miss
    FROM (SELECT doc_id, {KIND} AS k FROM documents)""",
)
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr(KIND)
    return read_table(spark, sf_dir, "documents").select("doc_id", op.eviction(kind).alias("eviction"), op.on_miss(kind).alias("on_miss"))


@query(
    "r4_eviction_victims",
    f"""WITH e AS (SELECT doc_id, source, n_chars FROM documents WHERE {KIND} <> 'EXEC_STATE'),
    f AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM e)
    SELECT doc_id, source FROM f WHERE freed < 20000""",
)
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.expr(KIND).alias("kind"))
    return op.eviction_victims(rows, ["source"], ["doc_id"], "n_chars", "kind", F.lit(20000)).select("doc_id", "source")


_OP = "CASE WHEN event_type = 'error' THEN 'erase' WHEN event_type IN ('view', 'click') THEN 'lookup' ELSE 'insert' END"


@query(
    "t1_queue_places",
    f"""WITH o AS (SELECT user_id, event_id AS seq, epoch_us(ts) AS ts_us, {_OP} AS op FROM events),
    l AS (SELECT *, coalesce(count(*) FILTER (op = 'erase') OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM o),
    h AS (SELECT *, coalesce(count(*) FILTER (op = 'insert') OVER (PARTITION BY user_id, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
                 ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY seq) AS gap_us FROM l)
    SELECT user_id, seq, op, CASE held WHEN 0 THEN 'miss' WHEN 1 THEN 'first' ELSE 'main' END AS "where", gap_us FROM h""",
)
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.expr("unix_micros(CAST(ts AS timestamp))").alias("ts_us"), F.expr(_OP).alias("op"))
    return op.reuse(op.queue_places(ops, ["user_id"], ["seq"]), ["user_id"], ["seq"], "ts_us").select("user_id", "seq", "op", "where", "gap_us")
