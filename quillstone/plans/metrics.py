"""Queries of metrics: event values in cents are samples, event types label them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import metrics as op
from quillstone.plans.registry import query
from quillstone.session import read_table

CENTS = "CAST(round(value * 100) AS BIGINT)"
SAMPLES_SQL = f"s AS (SELECT event_id, ts, user_id, event_type, {CENTS} AS v FROM events)"
BOUNDS = [100.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0, 20000.0]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.expr(CENTS).alias("v"))


@query("a4_counter", f"WITH {SAMPLES_SQL} SELECT event_type, user_id, sum(v)::BIGINT AS total FROM s GROUP BY ALL")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.counter(samples(spark, sf_dir), ["event_type", "user_id"], "v")


@query("a5_gauge", f"WITH {SAMPLES_SQL} SELECT user_id, arg_max(v, (ts, event_id)) AS value FROM s GROUP BY ALL")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.gauge(samples(spark, sf_dir), ["user_id"], "v", ["ts", "event_id"])


_BUCKETS = ", ".join(f"('{b}', {b})" for b in BOUNDS)


@query(
    "a6_histogram",
    f"""WITH {SAMPLES_SQL}, b(le, bound) AS (VALUES {_BUCKETS}, ('+Inf', NULL))
    SELECT event_type, le, count(*) FILTER (bound IS NULL OR v < bound) AS count, sum(v)::BIGINT AS total, count(*) AS n FROM s, b GROUP BY event_type, le""",
)
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.histogram(samples(spark, sf_dir), ["event_type"], "v", BOUNDS)


def _summary(labels: str) -> str:
    quantile = lambda q, p: f"list_sort(list(v))[least(count(*) - 1, floor({p}::DOUBLE * count(*))::BIGINT) + 1] AS {q}"
    return f"""WITH {SAMPLES_SQL} SELECT {labels}, count(*) AS n, min(v) AS min, max(v) AS max, sum(v)::BIGINT AS total,
    {", ".join(quantile(q, p) for q, p in op.SUMMARY.items())} FROM s GROUP BY {labels}"""


@query("a7_latency_summary", _summary("event_type"))
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latency_summary(samples(spark, sf_dir), ["event_type"], "v")


@query("a9_tenant_throughput", _summary("user_id"))
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latency_summary(samples(spark, sf_dir), ["user_id"], "v")


@query(
    "a8_jain_fairness",
    f"""WITH {SAMPLES_SQL}, u AS (SELECT event_type, user_id, sum(v)::BIGINT AS x FROM s GROUP BY ALL)
    SELECT event_type, sum(x)::DOUBLE * sum(x)::DOUBLE / (count(*) * sum(x::HUGEINT * x)::DOUBLE) AS fairness FROM u GROUP BY event_type""",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_user = op.counter(samples(spark, sf_dir), ["event_type", "user_id"], "v")
    return op.jain_fairness(per_user, ["event_type"], "total")


INCREASE_SQL = f"""{SAMPLES_SQL}, c AS (SELECT event_id, ts, user_id, v % 1000 AS v FROM s),
    g AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS grown
          FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    inc AS (SELECT event_id, ts, user_id, v, (sum(grown) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
            RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))::BIGINT AS increase FROM g)"""


def increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = samples(spark, sf_dir).select("event_id", "ts", "user_id", (F.col("v") % 1000).alias("v"))
    return op.increase(series, ["user_id"], "v", "ts", 86_400, "event_id")


@query("w4_rate_increase", f"WITH {INCREASE_SQL} SELECT event_id, increase, increase / 86400.0::DOUBLE AS rate FROM inc")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return increases(spark, sf_dir).select("event_id", "increase", (F.col("increase") / F.lit(86400.0)).alias("rate"))


@query(
    "w5_alert_for",
    f"""WITH {INCREASE_SQL}, b AS (SELECT *, increase > 600 AS breach FROM inc),
    i AS (SELECT *, sum(CASE WHEN breach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM b),
    m AS (SELECT *, min(CASE WHEN breach THEN epoch_us(ts) END) OVER (PARTITION BY user_id, island) AS since FROM i)
    SELECT event_id, breach AND coalesce(epoch_us(ts) - since >= 36000000000, false) AS firing FROM m""",
)
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.held(increases(spark, sf_dir), ["user_id"], F.col("increase") > 600, "ts", 36_000, "event_id")
    return rows.select("event_id", F.coalesce("firing", F.lit(False)).alias("firing"))


@query(
    "a10_hit_ratio",
    f"""WITH {SAMPLES_SQL} SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE v END)::DOUBLE / CASE WHEN sum(v) > 0 THEN sum(v) END::DOUBLE AS ratio FROM s GROUP BY user_id""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hit_ratio(samples(spark, sf_dir), ["user_id"], "v", F.col("event_type") == "error")


def _quantile_sql(q: float) -> str:
    value = f"{BOUNDS[-1]}::DOUBLE"
    for i in range(len(BOUNDS) - 1, -1, -1):
        low, below = (BOUNDS[i - 1], f"c{i - 1}") if i else (0.0, "0")
        value = f"CASE WHEN c{i} >= {q}::DOUBLE * n THEN {low}::DOUBLE + {BOUNDS[i] - low}::DOUBLE * ({q}::DOUBLE * n - {below}) / nullif(c{i} - {below}, 0) ELSE {value} END"
    counts = ", ".join(f"count(*) FILTER (v <= {b}) AS c{i}" for i, b in enumerate(BOUNDS))
    return f"WITH {SAMPLES_SQL}, c AS (SELECT event_type, count(*) AS n, {counts} FROM s GROUP BY event_type) SELECT event_type, {value} AS value FROM c"


@query("a11_histogram_quantile", _quantile_sql(0.99))
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.histogram_quantile(samples(spark, sf_dir), ["event_type"], "v", BOUNDS, 0.99)


@query(
    "w11_starvation",
    """WITH d AS (SELECT event_id, user_id, event_type = 'purchase' AS hit FROM events),
    r AS (SELECT *, sum(hit::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM d)
    SELECT event_id, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS skips FROM r""",
)
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return op.starvation(rounds, ["user_id"], "event_id", F.col("event_type") == "purchase").select("event_id", "skips")


LINE_SQL = """'kv_' || event_type || '_total{user="' || user_id || '"} ' || event_id % 50"""


@query("s30_prometheus_sink", f"SELECT {LINE_SQL} AS line FROM events")
def s30(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    name = F.concat(F.lit("kv_"), "event_type", F.lit("_total"))
    return op.prometheus_lines(rows, name, {"user": F.col("user_id").cast("string")}, F.col("event_id") % 50)


BAD_LINES = "CASE event_id % 10 WHEN 3 THEN '# HELP x' WHEN 4 THEN '' WHEN 5 THEN 'broken' WHEN 6 THEN 'kv_x abc' ELSE "
PARSED_SQL = f"""l AS (SELECT {BAD_LINES} {LINE_SQL} END AS line FROM events),
    m AS (SELECT regexp_extract(line, '^(.*) ([^ ]*)$', 1) AS name, try_cast(regexp_extract(line, '^(.*) ([^ ]*)$', 2) AS DOUBLE) AS value
          FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
    parsed AS (SELECT * FROM m WHERE name <> '' AND value IS NOT NULL)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.parse_prometheus(read_table(spark, sf_dir, "events").select(F.expr(f"{BAD_LINES} {LINE_SQL} END").alias("line")))


@query("s31_prometheus_parse", f"WITH {PARSED_SQL} SELECT name, value FROM parsed")
def s31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query("s42_metrics_fetch", f"WITH {PARSED_SQL} SELECT count(*) AS n, count(DISTINCT name) AS names FROM parsed")
def s42(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query("c2_inspect", f"WITH {PARSED_SQL} SELECT name, count(*) AS n, max(value) AS value FROM parsed GROUP BY name")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), F.max("value").alias("value"))


@query("p24_metric_prefix", f"WITH {PARSED_SQL} SELECT name, value FROM parsed WHERE starts_with(name, 'kv_click')")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_name_prefix(_lines(spark, sf_dir), "kv_click")


@query("c3_tier_stats", f"WITH {PARSED_SQL} SELECT name, sum(value) AS total FROM parsed WHERE starts_with(name, 'kv_view') GROUP BY name")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.with_name_prefix(_lines(spark, sf_dir), "kv_view").groupBy("name").agg(F.sum("value").alias("total"))


# Fixed thresholds of the alert rules: metric, comparison, threshold.
RULES = {
    "HitRateDrop": ("hit_ratio", "<", 0.30),
    "ColdTierLatencyHigh": ("cold_p99", ">", 5.0),
    "NodeUnhealthy": ("unreachable", ">", 0.0),
    "QuotaBreach": ("breach_increase", ">", 0.0),
    "EvictionStorm": ("eviction_rate", ">", 100.0),
    "PinnedTierSaturated": ("pinned_utilization", ">", 0.9),
    "ReserveNomemSpike": ("nomem_rate", ">", 0.0),
    "RetireBacklog": ("pending_retires", ">", 100000.0),
    "WritesStalled": ("epoch_rate", "==", 0.0),
}
_METRICS = [m for m, _, _ in RULES.values()]
_METRIC_SQL = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_METRICS)) + " END"
_VALUE_SQL = "(CASE WHEN event_id % 9 = 7 THEN 5000 ELSE 1 END) * ((event_id % 113) / 50.0)"
_ALERT_SQL = " UNION ALL ".join(f"SELECT event_id, '{a}' AS alert FROM m WHERE metric = '{m}' AND value {'=' if o == '==' else o} {t}" for a, (m, o, t) in RULES.items())


@query("c9_alert_rules", f"WITH m AS (SELECT event_id, {_METRIC_SQL} AS metric, {_VALUE_SQL}::DOUBLE AS value FROM events) {_ALERT_SQL}")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.expr(_METRIC_SQL).alias("metric"), F.expr(_VALUE_SQL).cast("double").alias("value"))
    return op.alerts(rows, RULES).select("event_id", "alert")
