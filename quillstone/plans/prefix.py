"""Queries of prefix matching: words are tokens, lang is the tenant, even ids are sealed, odd ones ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import prefix as op
from quillstone.plans.registry import query
from quillstone.session import read_table

TOKENS_SQL = """
    t AS (SELECT doc_id, lang, n_chars, md5(lang || '|m') AS ns, string_split(text, ' ') AS w FROM documents),
    p AS (SELECT doc_id, lang, ns, w, len(w) // 16 AS depth,
                 CASE WHEN len(w) >= 16 THEN md5(array_to_string(w[1:(len(w) // 16) * 16], ' ')) END AS h FROM t),
    sealed AS (SELECT ns, depth, h, max(doc_id) AS owner FROM p WHERE doc_id % 2 = 0 AND depth > 0 GROUP BY ALL)
"""


def tokens():
    return F.split("text", " ")


def ns():
    return op.namespace(F.col("lang"), F.lit("m"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")


def sealed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = documents(spark, sf_dir).filter("doc_id % 2 = 0")
    return op.sealed_index(op.paths(even, "doc_id", ns(), tokens()), "doc_id")


@query(
    "j1_longest_prefix_match",
    f"""WITH {TOKENS_SQL},
    q AS (SELECT doc_id, ns, d AS depth, md5(array_to_string(w[1:d * 16], ' ')) AS h
          FROM t, unnest(range(1, len(w) // 16 + 1)) u(d) WHERE doc_id % 2 = 1),
    hit AS (SELECT q.doc_id, max(q.depth) AS depth, arg_max(s.owner, q.depth) AS owner
            FROM q JOIN sealed s USING (ns, depth, h) GROUP BY q.doc_id)
    SELECT t.doc_id, coalesce(hit.depth, 0) * 16 AS matched_tokens, hit.owner
    FROM t LEFT JOIN hit USING (doc_id) WHERE t.doc_id % 2 = 1""",
)
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = documents(spark, sf_dir).filter("doc_id % 2 = 1")
    return op.longest_prefix_match(odd, "doc_id", ns(), tokens(), sealed_index(spark, sf_dir))


@query(
    "j2_exact_path_lookup",
    f"WITH {TOKENS_SQL} SELECT p.doc_id, s.owner FROM p JOIN sealed s USING (ns, depth, h) WHERE p.doc_id % 2 = 1",
)
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = op.paths(documents(spark, sf_dir).filter("doc_id % 2 = 1"), "doc_id", ns(), tokens())
    return op.exact_match(odd, sealed_index(spark, sf_dir)).select("doc_id", "owner")


@query(
    "j3_upsert_by_path",
    f"""WITH {TOKENS_SQL},
    new AS (SELECT *, min(doc_id) OVER (PARTITION BY ns, depth, h) AS first FROM p WHERE doc_id % 3 = 0)
    SELECT n.doc_id, CASE WHEN n.depth = 0 THEN 'conflict' WHEN s.owner IS NOT NULL OR n.doc_id > n.first THEN 'replaced'
                          ELSE 'inserted' END AS result
    FROM new n LEFT JOIN sealed s USING (ns, depth, h)""",
)
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = op.paths(documents(spark, sf_dir).filter("doc_id % 3 = 0"), "doc_id", ns(), tokens())
    return op.upsert(sealed_index(spark, sf_dir), new, "doc_id")[1]


@query(
    "j4_remove_by_path",
    f"""WITH {TOKENS_SQL} SELECT depth, owner FROM sealed s
    WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id % 4 = 0 AND p.ns = s.ns AND p.depth = s.depth AND p.h = s.h)""",
)
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = op.paths(documents(spark, sf_dir).filter("doc_id % 4 = 0"), "doc_id", ns(), tokens())
    return op.remove(sealed_index(spark, sf_dir), gone).select("depth", "owner")


@query(
    "p5_chunk_hashes",
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
    SELECT doc_id, len(w) // 16 AS n_chunks,
           array_to_string(list_transform(range(0, len(w) // 16), lambda i: md5(array_to_string(w[i * 16 + 1:i * 16 + 16], ' '))), ',') AS chunks
    FROM t""",
)
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = documents(spark, sf_dir).select("doc_id", op.chunk_hashes(tokens()).alias("c"))
    return chunks.select("doc_id", F.size("c").cast("bigint").alias("n_chunks"), F.array_join("c", ",").alias("chunks"))


@query("p6_namespace", "SELECT DISTINCT lang, source, md5(lang || '|' || source) AS ns FROM documents")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read_table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return names.withColumn("ns", op.namespace(F.col("lang"), F.col("source")))


@query(
    "s3_seal",
    f"WITH {TOKENS_SQL} SELECT doc_id, depth, CASE WHEN depth = 0 THEN 'INVAL' ELSE 'OK' END AS status FROM p",
)
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.seal(documents(spark, sf_dir), "doc_id", ns(), tokens()).select("doc_id", F.col("depth").cast("bigint"), "status")


@query(
    "s5_seal_by_path",
    f"WITH {TOKENS_SQL} SELECT ns, depth, count(*) AS writes, max(doc_id) AS owner FROM p WHERE depth > 0 GROUP BY ns, depth, h",
)
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = op.paths(documents(spark, sf_dir), "doc_id", ns(), tokens()).filter("depth > 0")
    grouped = made.groupBy("ns", "depth", "hash").agg(F.count("*").alias("writes"), F.max("doc_id").alias("owner"))
    return grouped.select("ns", F.col("depth").cast("bigint"), "writes", "owner")


@query(
    "a17_index_stats",
    f"""WITH {TOKENS_SQL},
    nodes AS (SELECT ns, d, md5(array_to_string(w[1:d * 16], ' ')) AS h, max(CASE WHEN d = len(w) // 16 THEN 1 ELSE 0 END) AS leaf
              FROM t, unnest(range(1, len(w) // 16 + 1)) u(d) GROUP BY ALL)
    SELECT count(*) AS nodes, sum(leaf) AS leaves, max(d) AS depth FROM nodes""",
)
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.index_stats(documents(spark, sf_dir), ns(), tokens())


@query(
    "p34_new_matched_tokens",
    f"""WITH {TOKENS_SQL},
    turns AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n FROM conversations)
    SELECT conv_id, turn, greatest((sum(n) OVER (PARTITION BY conv_id ORDER BY turn)) // 16 * 16
           - coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS new_tokens
    FROM turns""",
)
def p34(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("turn")
    total = F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    matched = F.floor(total / op.CHUNK) * op.CHUNK
    return turns.select("conv_id", "turn", op.new_matched_tokens(matched, before).cast("bigint").alias("new_tokens"))
