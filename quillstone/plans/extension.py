"""Queries of the plug-in points, the engine views and what is left of state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillstone.api import ENGINE_VERBS, EngineView, StateFrame
from quillstone.functions.text import epoch_millis
from quillstone.operators import providers, requests as steps, security, stack, tiers
from quillstone.plans import routing, security as rules, streams
from quillstone.plans.registry import ORACLES, fold_sql, query
from quillstone.session import ensure_checkpoint_dir, read_table, small_batches
from quillstone.streaming import feeds

ENGINES = {"e3": "sglang", "e4": "aibrix", "e5": "dynamo", "e6": "lmdeploy", "e7": "mii", "e8": "tgi", "e9": "vllm", "e10": "trtllm", "e11": "rust"}


def _engine_query(engine: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = EngineView(StateFrame(spark, f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4()}"), engine)
        _, store, retrieve, drop = ENGINE_VERBS[engine]
        getattr(view, store)(streams._requests(spark, sf_dir, 0))
        asked = streams._requests(spark, sf_dir, 1)
        if getattr(view, drop)(asked):
            raise ValueError("an engine removed state")
        found = getattr(view, f"{retrieve}_async")(asked)
        return found.select("id", "matched_tokens", "owner", F.md5("payload").alias("digest"))

    return run


for _key, _engine in ENGINES.items():
    query(f"{_key}_{_engine}", ORACLES["e1_store_lookup_retrieve"])(_engine_query(_engine))


_N = "len(string_split(text, ' '))"


@query(
    "e9_request_lifecycle",
    f"""WITH m AS ({ORACLES["e1_store_lookup_retrieve"]}),
    q AS (SELECT doc_id AS id, doc_id % 40 AS computed, CASE WHEN doc_id % 7 = 1 THEN 100 ELSE 1000000 END AS asked, {_N} AS n FROM documents WHERE doc_id % 2 = 1 AND doc_id % 11 <> 0),
    l AS (SELECT id, sum(32 * n + layer)::BIGINT AS bytes, count(*) = 4 AS whole FROM q, unnest(range(4)) r(layer) WHERE NOT (id % 5 = 0 AND layer = 2) GROUP BY id)
    SELECT q.id, greatest(m.matched_tokens - computed, 0)::BIGINT AS extra, (CASE WHEN m.matched_tokens > 0 AND asked >= 32 * m.matched_tokens THEN 32 * m.matched_tokens ELSE 0 END)::BIGINT AS load_bytes,
           m.matched_tokens > 0 AND asked >= 32 * m.matched_tokens AS loaded, l.bytes AS saved_bytes, l.whole AS saved
    FROM q JOIN m ON m.id = q.id JOIN l ON l.id = q.id""",
)
def e9_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = StateFrame(spark, f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4()}")
    frame.store(streams._requests(spark, sf_dir, 0))
    asked = streams._requests(spark, sf_dir, 1)
    requests = asked.select("id", (F.col("id") % 40).alias("computed"), F.when(F.col("id") % 7 == 1, 100).otherwise(1_000_000).alias("asked_bytes"))
    layers = asked.select("id", F.size("tokens").alias("tokens"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("layer"))
    layers = layers.filter("NOT (id % 5 = 0 AND layer = 2)").select("id", "layer", (32 * F.col("tokens") + F.col("layer")).alias("bytes"), F.lit(0).alias("n"))
    return steps.request_lifecycle(requests, frame.lookup(asked), layers, asked.filter("id % 11 = 0"), 4, 32)


_STEP = "CASE event_id % 7 WHEN 0 THEN 'reserve' WHEN 1 THEN 'publish' WHEN 2 THEN 'publish' WHEN 3 THEN 'seal' WHEN 4 THEN 'fetch' WHEN 5 THEN 'fetch' ELSE 'release' END"
_OWN = "OVER (PARTITION BY user_id, life ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "e11_context_protocol",
    f"""WITH s AS (SELECT user_id, event_id, {_STEP} AS op, event_id % 50 AS watermark FROM events),
    v AS (SELECT *, coalesce(count(*) FILTER (op = 'release') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM s),
    a AS (SELECT *, count(*) FILTER (op = 'reserve') {_OWN} > 0 AS reserved FROM v),
    b AS (SELECT *, count(*) FILTER (op = 'publish' AND reserved) {_OWN} > 0 AS written FROM a),
    c AS (SELECT *, count(*) FILTER (op = 'seal' AND reserved AND written) {_OWN} > 0 AS sealed FROM b),
    d AS (SELECT *, max(CASE WHEN op = 'publish' AND reserved AND NOT sealed THEN watermark END) {_OWN} AS mark FROM c)
    SELECT user_id, event_id, op, watermark, CASE WHEN op = 'reserve' THEN CASE WHEN reserved THEN 'busy' ELSE 'ok' END
           WHEN op = 'fetch' THEN CASE WHEN sealed THEN 'ok' ELSE 'not_found' END WHEN NOT reserved THEN 'unknown' WHEN op = 'release' THEN 'ok' WHEN sealed THEN 'sealed'
           WHEN op = 'seal' THEN CASE WHEN written THEN 'ok' ELSE 'empty' END ELSE CASE WHEN watermark < mark THEN 'stale' ELSE 'ok' END END AS status FROM d""",
)
def e11_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_STEP).alias("op"), (F.col("event_id") % 50).alias("watermark"))
    return steps.context_protocol(log, "user_id", "event_id")


@query("s43_open_state", "SELECT 'missing' AS at, 0 AS writes UNION ALL SELECT 'stored', count(*) FROM documents WHERE doc_id % 2 = 0 AND len(string_split(text, ' ')) >= 16")
def s43(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4()}"
    none = StateFrame(spark, f"{folder}/none").table().agg(F.lit("missing").alias("at"), F.count("*").alias("writes"))
    StateFrame(spark, f"{folder}/some").store(streams._requests(spark, sf_dir, 0))
    return none.unionByName(StateFrame(spark, f"{folder}/some").table().agg(F.lit("stored").alias("at"), F.count("*").alias("writes")))


@query(
    "t2_deferred_eviction",
    fold_sql(
        "SELECT user_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'acquire' WHEN 'click' THEN 'release' WHEN 'error' THEN 'evict' ELSE 'insert' END AS op FROM events",
        "user_id",
        "seq",
        {
            "there": ("false", "CASE WHEN s.op = 'insert' THEN true WHEN f.there AND s.op = 'release' AND f.waiting AND f.holds <= 2 THEN false WHEN f.there AND s.op = 'evict' THEN f.holds > 1 ELSE f.there END"),
            "holds": ("1::BIGINT", "CASE WHEN s.op = 'insert' THEN 1 WHEN f.there AND s.op = 'acquire' THEN f.holds + 1 WHEN f.there AND s.op = 'release' THEN greatest(1, f.holds - 1) ELSE f.holds END"),
            "waiting": ("false", "CASE WHEN s.op = 'insert' THEN false WHEN f.there AND s.op = 'release' AND f.waiting AND f.holds <= 2 THEN false WHEN f.there AND s.op = 'evict' THEN f.holds > 1 ELSE f.waiting END"),
            "outcome": ("NULL::VARCHAR", "CASE WHEN s.op = 'insert' AND f.waiting THEN 'dropped' WHEN f.there AND s.op = 'release' AND f.waiting AND f.holds <= 2 THEN 'pruned' WHEN f.there AND s.op = 'evict' THEN CASE WHEN f.holds = 1 THEN 'pruned' ELSE 'deferred' END END"),
        },
        "user_id, seq, outcome",
        "outcome IS NOT NULL",
    ),
)
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.expr("CASE event_type WHEN 'view' THEN 'acquire' WHEN 'click' THEN 'release' WHEN 'error' THEN 'evict' ELSE 'insert' END").alias("op")
    return tiers.deferred_evictions(read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), op), "user_id", "seq")


@query(
    "t13_decision_cache",
    "SELECT user_id, event_type, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type, epoch_ms(ts) // 21600000 ORDER BY ts, event_id) > 1 AS hit FROM events",
)
def t13(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = epoch_millis(F.col("ts")).alias("ts_ms")
    rows = read_table(spark, sf_dir, "events").select("user_id", "event_type", at, F.col("event_id").alias("seq"))
    return security.aligned_decisions(rows, ["user_id", "event_type"], "ts_ms", ["seq"], 6 * 3_600_000).drop("ts_ms")


@query(
    "x3_providers",
    f"""WITH {routing.SCORES}, {routing.BEST}, {routing.CACHE}, known AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0)
    SELECT event_id, CASE WHEN k.user_id IS NULL THEN 'bloom_miss' WHEN cached IS NOT NULL THEN 'cache' ELSE 'hrw' END AS source,
           CASE WHEN k.user_id IS NOT NULL THEN coalesce(cached, b.node) END AS node
    FROM cache c JOIN best b USING (user_id) LEFT JOIN known k USING (user_id) WHERE b.rank = 1""",
)
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    router = providers.Router(
        nodes=lambda: read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), (F.col("n_regionkey") + 1.0).alias("weight")),
        cache=lambda: events.filter("event_type = 'view'").select("user_id", "ts", F.concat(F.lit("n"), F.col("event_id") % 7).alias("node")),
        known=lambda: events.filter("event_type = 'purchase' AND event_id % 3 = 0").select("user_id"),
        ttl_seconds=6 * 3600,
    )
    asked = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return router.read(asked, "user_id", "ts").select("event_id", "source", "node")


@query("x4_storage_stack", "SELECT s.name, page_id, md5(html) AS digest FROM pages, (VALUES ('plain'), ('deflate'), ('deflate+aes')) s(name)")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    key = F.lit("0123456789abcdef")
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.encode("html", "utf-8").alias("b"))
    stacks = [stack.Stack(), stack.Stack(stack.deflate()), stack.Stack(stack.deflate(), stack.aes(key))]
    parts = []
    for s in stacks:
        stored = pages.select("page_id", s.put(F.col("b")).alias("x"))
        parts.append(stored.select(F.lit(s.name).alias("name"), "page_id", F.md5(s.get(F.col("x"))).alias("digest")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("x5_event_callback", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/callback-{uuid.uuid4()}"

    def callback(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    feeds.on_event(streams._stream(spark, sf_dir), callback, f"{folder}-state")()
    return spark.read.parquet(folder).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("x6_observers", f"WITH {rules.BOUNDARY_SQL} SELECT count(*) AS checked, count(*) FILTER (reason <> '') AS denied FROM bc")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = Observation()
    checked = rules._checked(spark, sf_dir).observe(seen, F.count("*").alias("checked"), F.count_if(~F.col("allow")).alias("denied"))
    checked.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["checked"], seen.get["denied"])], "checked bigint, denied bigint")


@query("x7_replica_source", "SELECT l.doc_id, md5(CASE WHEN d.doc_id % 7 = 0 THEN d.text ELSE d.lang END) AS payload FROM labels l JOIN documents d USING (doc_id) WHERE d.doc_id % 7 = 0 OR d.doc_id % 2 = 0")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    near = lambda: docs.filter("doc_id % 7 = 0").select("doc_id", F.md5("text").alias("payload"))
    far = lambda: docs.filter("doc_id % 2 = 0").select("doc_id", F.md5("lang").alias("payload"))
    return providers.fetch_replicas(read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", near, far)
