"""Queries of the streaming forms, run over what is there, and of the facade."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.api import EngineView, StateFrame
from quillstone.functions.text import epoch_millis
from quillstone.operators import membership, policies
from quillstone.plans import membership as members
from quillstone.plans import qos, sketch
from quillstone.plans.prefix import TOKENS_SQL
from quillstone.plans.registry import query
from quillstone.session import ensure_checkpoint_dir, read_table
from quillstone.sources import tables
from quillstone.streaming import feeds

SHAPE = "event_id, 's' || user_id % 4 AS stream, 'k' || user_id AS key, CASE event_type WHEN 'error' THEN 'EVICT' ELSE 'ADD' END AS type, event_id % 5 + 1 AS tier, event_id AS epoch"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, so that a table of one file and one of a folder are both read
    return feeds.events(spark, f"{path}*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("s26_event_stream", f"SELECT stream, type, count(*) AS n, max(epoch) AS last FROM (SELECT {SHAPE} FROM events) GROUP BY ALL")
def s26(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _stream(spark, sf_dir).selectExpr(*SHAPE.split(", "))
    grouped = feed.groupBy("stream", "type").agg(F.count("*").alias("n"), F.max("epoch").alias("last"))
    return feeds.run_to_end(grouped, "complete")


@query("s27_wire_stream", f"SELECT type, epoch FROM (SELECT {SHAPE} FROM events)")
def s27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.run_to_end(feeds.project(_stream(spark, sf_dir).selectExpr(*SHAPE.split(", "))))


@query(
    "t5_replication",
    f"""SELECT e.event_id, e.stream, e.key, e.epoch, md5(c_name) AS payload FROM (SELECT {SHAPE} FROM events) e JOIN customer ON key = 'k' || c_custkey
    WHERE type = 'ADD' AND tier BETWEEN 1 AND 2 AND c_custkey % 3 <> 0 AND epoch > 0""",
)
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0")
    primary = customer.select(F.concat(F.lit("k"), "c_custkey").alias("key"), F.md5("c_name").alias("payload"))
    path = f"{ensure_checkpoint_dir(spark)}/replica-{uuid.uuid4()}"
    feeds.replicate(_stream(spark, sf_dir).selectExpr(*SHAPE.split(", ")), primary, path, max_tier=2)()
    return spark.read.parquet(path).select("event_id", "stream", "key", "epoch", "payload")


@query(
    "t12_bloom_stream",
    f"""SELECT DISTINCT time_bucket(INTERVAL '30 seconds', ts) AS start, {sketch._bits('user_id::VARCHAR')} AS bit FROM events, {sketch.IS}
    WHERE time_bucket(INTERVAL '30 seconds', ts) + INTERVAL '30 seconds' <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""",
)
def t12_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feeds.published_sketches(_stream(spark, sf_dir), "ts", F.col("user_id").cast("string"), sketch.M, sketch.K)
    return feeds.run_to_end(found)


@query(
    "w9_debounce_stream",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS changes FROM s GROUP BY user_id, n
    HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)""",
)
def w9_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.run_to_end(feeds.debounced(_stream(spark, sf_dir), ["user_id"], "ts", "2 hours"))


@query("t8_admission_stream", qos.ADMIT_SQL)
def t8_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir)
    release = F.when(F.col("event_type") == "purchase", F.col("event_id") % 64 + 1).otherwise(0)
    requests = rows.select(
        F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), epoch_millis(F.col("ts")).alias("ts_ms"),
        (F.col("event_id") % 64).alias("bytes"), F.lit(1).alias("requests"), (F.col("event_id") % 900).alias("bandwidth"), release.alias("released"),
    )
    return feeds.run_to_end(feeds.admitted(requests, qos._limits(spark, sf_dir), 6 * 3_600_000))


@query("t11_membership_stream", members.T11_SQL)
def t11_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = _stream(spark, sf_dir).select("event_id", "user_id", F.expr(members.TARGET).alias("target")).filter("target <> 'terminated' OR event_id % 20 = 0")
    return feeds.run_to_end(feeds.folded(feed, membership.membership_fold("user_id", "bigint", "event_id", "target")))


@query("s17_object_uri", "SELECT doc_id, 's3a://cold/' || substr(md5(text), 1, 2) || '/' || substr(md5(text), 3) || '.kv' AS uri FROM documents")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", tables.object_uri("cold", F.md5("text")).alias("uri"))


@query("s16_cold_tier_put_get", "SELECT md5(text) AS key, max(length(text)) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1")
def s16_put_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark)}/cold-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"), F.length("text").alias("n"))
    tables.put_blobs(docs, path, "key", "n")
    got = tables.get_blobs(spark, path, docs.filter("doc_id % 3 = 0").select("key"), "key")
    return got.groupBy("key").agg(F.max("n").alias("n"))


@query("x1_policy_registry", """SELECT doc_id, CASE lang WHEN 'de' THEN quality = 1 WHEN 'fr' THEN n_chars > 500 ELSE true END AS store,
    CASE lang WHEN 'de' THEN 'pinned' ELSE 'evict' END AS eviction, CASE lang WHEN 'de' THEN 'replay' ELSE 'recompute' END AS on_miss
    FROM documents JOIN labels USING (doc_id)""")
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = policies.PolicyRegistry()
    registry.register("de", lambda c: c["quality"] == 1, lambda c: F.lit("pinned"), lambda c: F.lit("replay"))
    registry.register("fr", lambda c: c["n_chars"] > 500, lambda c: F.lit("evict"), lambda c: F.lit("recompute"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return registry.apply(rows, "lang").select("doc_id", "store", "eviction", "on_miss")


def _requests(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").filter(f"doc_id % 2 = {rest}")
    words = F.split("text", " ")
    payload = F.encode(F.array_join(F.transform(words, lambda w: F.md5(w)), ""), "utf-8")
    return rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("tenant"), F.lit("m").alias("model"), words.alias("tokens"), payload.alias("payload"))


@query(
    "e1_store_lookup_retrieve",
    f"""WITH {TOKENS_SQL},
    q AS (SELECT doc_id, ns, d AS depth, md5(array_to_string(w[1:d * 16], ' ')) AS h FROM t, unnest(range(1, len(w) // 16 + 1)) u(d) WHERE doc_id % 2 = 1),
    hit AS (SELECT q.doc_id, max(q.depth) AS depth, arg_max(s.owner, q.depth) AS owner FROM q JOIN sealed s USING (ns, depth, h) GROUP BY q.doc_id)
    SELECT t.doc_id AS id, coalesce(depth, 0) * 16 AS matched_tokens, owner,
           md5(array_to_string(list_transform(o.w[1:depth * 16], lambda x: md5(x)), '')) AS digest
    FROM t LEFT JOIN hit USING (doc_id) LEFT JOIN t o ON o.doc_id = hit.owner WHERE t.doc_id % 2 = 1""",
)
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = EngineView(StateFrame(spark, f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4()}"), "sglang")
    engine.store(_requests(spark, sf_dir, 0))
    found = engine.retrieve(_requests(spark, sf_dir, 1))
    return found.select("id", "matched_tokens", "owner", F.md5("payload").alias("digest"))


@query(
    "e2_compressed_payload",
    "SELECT doc_id AS id, md5(text) AS digest FROM documents",
)
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), StateFrame.compress_store(F.encode("text", "utf-8")).alias("s"))
    return stored.select("id", F.md5(StateFrame.compress_retrieve(F.col("s"))).alias("digest"))
