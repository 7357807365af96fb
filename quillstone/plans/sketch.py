"""Queries of sketches: documents' whole texts are the keys of their language's node.

Where one side asks what the other has stored, even documents are stored and odd ones ask. All
sketches of a query have one size, of the number of keys stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import sketch as op
from quillstone.plans.registry import query
from quillstone.session import read_table

RATE = 0.01
#: Bits of a window's sketch of users (T12), and the hashes of each key at this rate.
M, K = op.bloom_params(1024, RATE)


def _hash(part: int, key: str) -> str:
    return f"('0x' || substr(md5({key}), {13 * part + 1}, 13))::BIGINT"


def _bits(key: str, m: str | int = M) -> str:
    return f"(({_hash(0, key)} + i * {_hash(1, key)}) % {m})"


IS = f"unnest(range({K})) r(i)"


def _sketch_sql(stored: str) -> str:
    size = f"ceil(ceil(-greatest(count(*), 1) * ln({RATE}::DOUBLE) / 0.4804530139182014::DOUBLE) / 64) * 64"
    return f"""size AS (SELECT ({size})::BIGINT AS m FROM documents WHERE {stored}),
    sk AS (SELECT DISTINCT lang AS node, {_bits('text', 'm')} AS bit FROM documents, size, {IS} WHERE {stored})"""


SKETCH_SQL = _sketch_sql("doc_id % 2 = 0")
WHOLE_SQL = _sketch_sql("true")
PROBE_SQL = f"pr AS (SELECT DISTINCT doc_id, lang, {_bits('text', 'm')} AS bit FROM documents, size, {IS} WHERE doc_id % 2 = 1)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def sketch(spark: SparkSession, sf_dir: str, stored: str = "true") -> tuple[DataFrame, int]:
    """The sketches of the stored documents, and their bits."""
    rows = documents(spark, sf_dir).filter(stored)
    m, k = op.bloom_params(rows.count(), RATE)
    return op.build_sketch(rows, F.col("lang"), F.col("text"), m, k), m


EVEN, ODD = "doc_id % 2 = 0", "doc_id % 2 = 1"


@query("a1_bloom_build", f"WITH {WHOLE_SQL} SELECT node, bit // 32 AS word, sum(1::BIGINT << (bit % 32)::INT)::BIGINT AS value FROM sk GROUP BY ALL")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.to_words(sketch(spark, sf_dir)[0]).select("node", "word", "value")


@query(
    "a2_bloom_sizing",
    """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r(rate) AS (VALUES (0.01), (0.001), (0.05), (0.0), (1.5)),
    x AS (SELECT lang, n, rate, -n * ln(CASE WHEN rate > 0 AND rate < 1 THEN rate ELSE 0.01 END::DOUBLE) / 0.4804530139182014::DOUBLE AS bits FROM s, r)
    SELECT lang, n, rate::DOUBLE AS rate, (ceil(ceil(bits) / 64) * 64)::BIGINT AS m, greatest(round(bits / n * 0.6931471805599453::DOUBLE), 1)::INT AS k FROM x""",
)
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    rows = sizes.withColumn("rate", F.explode(F.array(*[F.lit(x) for x in (0.01, 0.001, 0.05, 0.0, 1.5)])))
    m, k = op.bloom_params_columns(F.col("n"), F.col("rate"))
    return rows.select("lang", "n", "rate", m.alias("m"), k.alias("k"))


@query("a3_bloom_merge", f"WITH {WHOLE_SQL} SELECT max(m) AS m, {K} AS k, count(DISTINCT bit) AS n_bits FROM sk, size")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, m = sketch(spark, sf_dir)
    return op.merged_header(op.merge_sketches(every, m, K))


@query("u1_sketch_union", f"WITH {WHOLE_SQL} SELECT DISTINCT bit FROM sk WHERE node IN ('en', 'de')")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, m = sketch(spark, sf_dir)
    return op.merge_sketches(every.filter("node = 'en'").union(every.filter("node = 'de'")), m, K).select("bit")


@query(
    "j5_bloom_probe",
    f"WITH {SKETCH_SQL}, {PROBE_SQL}, u AS (SELECT DISTINCT bit FROM sk) SELECT doc_id, bool_and(u.bit IS NOT NULL) AS maybe FROM pr LEFT JOIN u USING (bit) GROUP BY doc_id",
)
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, m = sketch(spark, sf_dir, EVEN)
    return op.maybe_contains(documents(spark, sf_dir).filter(ODD), "doc_id", F.col("text"), op.merge_sketches(stored, m, K), m, K)


@query("j6_aggregated_probe_empty", "SELECT doc_id, false AS maybe FROM documents WHERE doc_id % 2 = 1")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, m = sketch(spark, sf_dir, EVEN)
    none = op.merge_sketches(stored, m + 64, K)  # no node has these parameters
    return op.maybe_contains(documents(spark, sf_dir).filter(ODD), "doc_id", F.col("text"), none, m, K)


def _node_probe(unknown: bool) -> str:
    return f"""WITH {SKETCH_SQL}, known AS (SELECT DISTINCT node FROM sk WHERE node <> 'fr'), {PROBE_SQL}
    SELECT pr.doc_id, CASE WHEN max(known.node) IS NULL THEN {unknown} ELSE bool_and(sk.bit IS NOT NULL) END AS maybe
    FROM pr LEFT JOIN sk ON sk.node = pr.lang AND sk.bit = pr.bit AND sk.node <> 'fr' LEFT JOIN known ON known.node = pr.lang GROUP BY pr.doc_id"""


def _own_node(spark: SparkSession, sf_dir: str, unknown: bool) -> DataFrame:
    stored, m = sketch(spark, sf_dir, EVEN)
    odd = documents(spark, sf_dir).filter(ODD)
    return op.node_maybe_has(odd, "doc_id", F.col("lang"), F.col("text"), stored.filter("node <> 'fr'"), m, K, unknown)


@query("j7_view_probe", _node_probe(True))
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own_node(spark, sf_dir, True)


@query("j8_peer_probe", _node_probe(False))
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own_node(spark, sf_dir, False)


@query(
    "p29_sketch_headers",
    """WITH h AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 5 = 4 THEN 0 WHEN s_suppkey % 7 = 3 THEN 128 ELSE 64 END AS m,
                    CASE WHEN s_suppkey % 11 = 5 THEN 0 ELSE 7 END AS k, s_nationkey AS n_bytes FROM supplier),
    u AS (SELECT * FROM h WHERE n_bytes >= 8 AND m > 0 AND k > 0 AND (n_bytes - 8) * 8 >= m)
    SELECT node, m, k, n_bytes FROM u WHERE m = (SELECT arg_min(m, node) FROM u) AND k = (SELECT arg_min(k, node) FROM u)""",
)
def p29(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("s_suppkey") % 5 == 4, 0).when(F.col("s_suppkey") % 7 == 3, 128).otherwise(64)
    k = F.when(F.col("s_suppkey") % 11 == 5, 0).otherwise(7)
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), m.alias("m"), k.alias("k"), F.col("s_nationkey").alias("n_bytes"))
    return op.valid_headers(rows)


@query(
    "t12_bloom_publish",
    f"""SELECT start, count(*) AS n_bits FROM (
        SELECT DISTINCT time_bucket(INTERVAL '30 seconds', ts) AS start, {_bits('user_id::VARCHAR')} AS bit FROM events, {IS}) GROUP BY start""",
)
def t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    each = op.windowed_sketch(events, "ts", F.col("user_id").cast("string"), M, K)
    return each.groupBy("start").agg(F.count("*").alias("n_bits"))


@query(
    "a21_view_stats",
    f"""WITH v AS ({_node_probe(True)}) SELECT count(*) AS queries, count_if(NOT maybe) AS answered_false FROM v""",
)
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _own_node(spark, sf_dir, True)
    return seen.agg(F.count("*").alias("queries"), F.count_if(~F.col("maybe")).alias("answered_false"))
