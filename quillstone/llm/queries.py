"""The registered queries of this subpackage: op1 .. op10, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, html, langid, packing, pii, quality, secrets, simhash, urls, winnow
from quillstone.session import read_table, small_batches

#: The end-of-document id of op3.
END_ID = 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where this environment keeps a public tokenizer's file; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, name)


#: The rules of op2, and hosts blocked where none of them fits.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
BLOCKED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com"]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(docs, keep_text=False)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in counts], "base_failed", "kept", "distance")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = whole_table(spark, sf_dir, "pages")
    found = pages.select("page_id", urls.judge(spark, F.col("url"), URL_RULES, BLOCKED_HOSTS).alias("j"))
    return found.select("page_id", "j.host", "j.path", "j.rule", "j.verdict")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.main_text(F.col("html")).alias("text")
    return whole_table(spark, sf_dir, "pages").select("page_id", "url", text).withColumn("n_chars", F.length("text").cast("long"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whole_table(spark, sf_dir, "documents").select("doc_id", secrets.find_secrets(F.col("text")).alias("s"))
    kind = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("s", lambda x: x["kind"] != "literal")
    return found.select(
        "doc_id",
        kind("assign"),
        kind("access"),
        kind("hex"),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("s")).alias("spans"),
    )


def held_out_fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = held_out_fold(F.col("doc_id"))
    model = langid.train(docs.filter(~fold), "text", "lang")
    found = docs.select("doc_id", fold.alias("held_out"), langid.predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(whole_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(whole_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = whole_table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), path).alias("decoded"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare_with_next(whole_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnow.as_text(F.col("fingerprint")).alias("fingerprint"),
        winnow.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(whole_table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.joined_spans(*pii.KINDS), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.joined_spans(*pii.KINDS, pii.FOUND).alias("spans"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_urls": op2_urls,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_secrets": op6_secrets,
    "op7_bpe": op7_bpe,
    "op8_langid": op8_langid,
    "op9_winnow": op9_winnow,
    "op10_pii": op10_pii,
}

_RULES_SQL = ", ".join(
    f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in URL_RULES
)
_HOSTS_SQL = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)

ORACLE_SQL: dict[str, str] = {
    "op2_urls": f"""
        WITH parts AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts
        ), rules(rule, rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
        best AS (
            SELECT s.page_id, s.host, s.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
            FROM split s LEFT JOIN rules r
              ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
            GROUP BY s.page_id, s.host, s.path
        )
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_HOSTS_SQL} THEN 'block' ELSE 'allow' END) AS verdict FROM best
    """,
}
