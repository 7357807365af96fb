"""Queries of scalar functions, identities and the codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import hashing, identity, text
from quillstone.operators import codec
from quillstone.plans.registry import fold_sql, query
from quillstone.session import read_table, small_batches


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer")


FNV_SQL = """f(c_custkey, s, i, h) AS (
    SELECT c_custkey, c_name, 0, 14695981039346656037::HUGEINT FROM customer
    UNION ALL SELECT c_custkey, s, i + 1, (xor(h::UBIGINT, ord(s[i + 1])::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT FROM f WHERE i < length(s)),
    fnv AS (SELECT c_custkey, s, lpad(lower(printf('%x', h::UBIGINT)), 16, '0') AS fnv FROM f WHERE i = length(s))"""


@query("f1_fnv1a64", f"WITH RECURSIVE {FNV_SQL} SELECT c_custkey, fnv FROM fnv")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", hashing.fnv1a64(F.col("c_name")).alias("fnv"))


@query("f2_identity_hash", "SELECT c_custkey, md5(c_name || '|' || c_mktsegment) AS h, sha256(c_name) AS h256 FROM customer")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", hashing.identity_hash(F.col("c_name"), F.col("c_mktsegment")).alias("h"), F.sha2("c_name", 256).alias("h256"))


@query("f3_short_digest", "SELECT c_custkey, substr(sha1(c_name), 1, 32) AS digest FROM customer")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", hashing.short_digest(F.col("c_name")).alias("digest"))


_BYTE = "(CASE WHEN s.i % 8 = 0 THEN xor(f.h, s.octet) ELSE f.h END)"
CRC_SQL = fold_sql(
    "SELECT c_custkey, i, ord(c_name[i // 8 + 1])::BIGINT AS octet, 8 * length(c_name) - 1 AS last FROM customer, unnest(range(8 * length(c_name))) r(i)",
    "c_custkey",
    "i",
    {"h": ("4294967295::BIGINT", f"CASE WHEN {_BYTE} & 1 = 1 THEN xor({_BYTE} >> 1, 3988292384) ELSE {_BYTE} >> 1 END")},
    "c_custkey, xor(h, 4294967295) AS crc",
    "s.i = s.last",
)


@query("f4_crc32", CRC_SQL)
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", hashing.checksum(F.col("c_name")).alias("crc"))


@query("f5_safe_key", "SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g'), 80) || '-' || substr(sha256(url), 1, 8) AS key FROM pages")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", hashing.safe_key(F.col("url")).alias("key"))


@query("f6_short_hex", "SELECT c_custkey, CASE WHEN length(lower(hex(c_name))) > 12 THEN left(lower(hex(c_name)), 12) || '…' ELSE lower(hex(c_name)) END AS h FROM customer")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", hashing.short_hex(F.col("c_name")).alias("h"))


BE = "lpad(lower(printf('%x', (c_custkey * 1000003)::BIGINT)), 16, '0')"
LE = " || ".join(f"substr({BE}, {i}, 2)" for i in range(15, 0, -2))


@query("f7_integer_packing", f"SELECT c_custkey, {BE} AS be, {LE} AS le, c_custkey * 1000003 AS back FROM customer")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") * 1000003
    le = hashing.little_endian(n)
    return _customers(spark, sf_dir).select("c_custkey", hashing.big_endian(n).alias("be"), le.alias("le"), hashing.from_little_endian(le).alias("back"))


NANOS = "CASE event_id % 50 WHEN 0 THEN 0 ELSE (event_id * 7919 + 13) * 1000000007 END"
CLOCK_SQL = f"CASE WHEN n = 0 THEN '-' ELSE strftime(make_timestamp(n // 1000), '%H:%M:%S.%g') END"


def _nanos() -> Column:
    """``NANOS`` as decimals, exact for every BIGINT id; as a BIGINT it overflows beyond 1.1 million events."""
    n = (F.col("event_id").cast("decimal(20,0)") * 7919 + 13) * 1_000_000_007
    return F.when(F.col("event_id") % 50 == 0, 0).otherwise(n)


@query("f8_clock", f"WITH t AS (SELECT event_id, ({NANOS})::BIGINT AS n FROM events) SELECT event_id, {CLOCK_SQL} AS at FROM t")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", text.clock(_nanos()).alias("at"))


@query("f9_event_line", f"WITH t AS (SELECT event_id, event_type, ({NANOS})::BIGINT AS n FROM events) SELECT {CLOCK_SQL} || ' ' || upper(event_type) || ' epoch=' || event_id AS line FROM t")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.concat(F.lit("KV_EVENT_"), F.upper("event_type"))
    return read_table(spark, sf_dir, "events").select(text.event_line(text.clock(_nanos()), kind, F.col("event_id")).alias("line"))


@query("f13_status_names", "SELECT event_id, coalesce(['OK','INVAL','NOMEM','NOT_FOUND','TIER_DOWN','DENIED','INTERNAL'][event_id % 9 + 1], 'UNKNOWN') AS status FROM events")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", text.lookup((F.col("event_id") % 9).cast("int"), text.STATUS, "UNKNOWN").alias("status"))


@query(
    "p28_rpc_status",
    """SELECT event_id, coalesce(['OK','INVALID_ARGUMENT','RESOURCE_EXHAUSTED','NOT_FOUND','UNAVAILABLE','PERMISSION_DENIED'][event_id % 9 + 1], 'INTERNAL') AS rpc FROM events""",
)
def p28(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = text.lookup((F.col("event_id") % 9).cast("int"), text.STATUS, "UNKNOWN")
    return read_table(spark, sf_dir, "events").select("event_id", text.lookup(status, text.RPC_STATUS, "INTERNAL").alias("rpc"))


@query("f14_json_defaults", """SELECT event_id, coalesce(try_cast(('{"a":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"b":"x"' ELSE '' END || '}')::JSON->>'a' AS BIGINT), -1) AS a,
    CASE WHEN event_id % 2 = 0 THEN 'x' ELSE 'none' END AS b FROM events""")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("""'{"a":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"b":"x"' ELSE '' END || '}'""")
    parsed = F.from_json(body, "a bigint, b string")
    return read_table(spark, sf_dir, "events").select("event_id", F.coalesce(parsed["a"], F.lit(-1)).alias("a"), F.coalesce(parsed["b"], F.lit("none")).alias("b"))


@query("f15_next_power_of_two", "SELECT c_custkey, greatest((2 ** ceil(log2(c_custkey)))::BIGINT, 8) AS p FROM customer WHERE c_custkey > 0")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).filter("c_custkey > 0").select("c_custkey", text.next_power_of_two(F.col("c_custkey")).alias("p"))


@query("f16_url_encode", "SELECT page_id, url_encode(url || ' *~') AS encoded, 'a=' || url_encode(url) || '&b=' || page_id AS query FROM pages")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    pairs = F.array(pair("b", F.col("page_id").cast("string")), pair("a", F.col("url")))
    return read_table(spark, sf_dir, "pages").select("page_id", text.url_encode(F.concat("url", F.lit(" *~"))).alias("encoded"), text.canonical_query(pairs).alias("query"))


@query("f20_first_given", "SELECT c_custkey, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'opt' END, ''), nullif(CASE c_custkey % 2 WHEN 0 THEN 'env' END, ''), 'default') AS v FROM customer")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    option, env = F.expr("CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'opt' END"), F.expr("CASE c_custkey % 2 WHEN 0 THEN 'env' END")
    return _customers(spark, sf_dir).select("c_custkey", text.first_given(option, env, F.lit("default")).alias("v"))


@query("f21_ticker_export", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'storage_bytes_read_total ' || event_id WHEN 1 THEN 'storage_keys_written_total ' || event_id END AS line FROM events")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE event_id % 3 WHEN 0 THEN 'bytes_read' WHEN 1 THEN 'keys_written' ELSE 'other' END")
    return read_table(spark, sf_dir, "events").select("event_id", text.ticker_line(name, F.col("event_id")).alias("line"))


@query("f19_layer_slice", "SELECT doc_id, l AS layer, substr(text, (l * (length(text) // 6) + 1)::BIGINT, length(text) // 6) AS part FROM documents, unnest(range(6)) r(l)")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("layer"))
    return rows.select("doc_id", "layer", codec.layer_slice(F.col("b"), F.col("layer").cast("int"), 6).alias("part"))


def _locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = identity.locator(F.col("lang"), F.col("source"), F.md5("text"), F.lit(0), F.col("n_chars"))
    return read_table(spark, sf_dir, "documents").select("doc_id", loc.alias("l"))


@query("p1_make_locator", "SELECT doc_id, lang AS tenant, source AS model, md5(text) AS prefix, n_chars AS token_count, 1 AS version FROM documents")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _locators(spark, sf_dir).select("doc_id", "l.tenant", "l.model", "l.prefix", F.col("l.range.token_count").alias("token_count"), F.col("l.version").alias("version"))


@query(
    "p2_identity_equality",
    "SELECT doc_id, min(doc_id) OVER w AS same_as, count(*) OVER w AS members FROM documents WINDOW w AS (PARTITION BY lang, source, md5(text))",
)
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the least id of its class of equal identities, and the class's size; never its pairs."""
    rows = _locators(spark, sf_dir).select("doc_id", identity.identity_key(F.col("l")).alias("k"))
    classes = rows.groupBy("k").agg(F.min("doc_id").alias("same_as"), F.count("*").alias("members"))
    return rows.join(classes, rows["k"].eqNullSafe(classes["k"])).select("doc_id", "same_as", "members")


@query("p3_identity_hash", "SELECT doc_id, md5(lang || '|' || source || '|' || md5(text)) AS h FROM documents")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _locators(spark, sf_dir).select("doc_id", identity.locator_hash(F.col("l")).alias("h"))


@query("p4_locator_code", "SELECT doc_id, 112 AS width, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 END AS version FROM documents")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = identity.encode_locator(F.col("l"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.left(code, F.lit(96)), F.lit("02"), F.substring(code, 99, 99))).otherwise(code)
    return _locators(spark, sf_dir).select("doc_id", F.length(code).alias("width"), identity.decode_version(changed).alias("version"))


@query("p7_state_identity", "SELECT doc_id, 2 AS version, 'KV' AS state_kind, md5(lang || '|' || source || '|' || md5(text)) AS content_hash FROM documents")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = identity.state_identity(F.col("l"))
    return _locators(spark, sf_dir).select("doc_id", state["version"].alias("version"), state["state_kind"].alias("state_kind"), state["content_hash"].alias("content_hash"))


@query(
    "p8_tool_identity",
    f"WITH RECURSIVE {FNV_SQL} SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS flags, fnv || fnv AS content_hash FROM fnv",
)
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = identity.tool_identity(F.lit("t"), F.col("c_name"), F.col("c_name"), F.col("c_custkey") % 2 == 0)
    return _customers(spark, sf_dir).select("c_custkey", made["flags"].alias("flags"), made["content_hash"].alias("content_hash"))


_HALF = lambda e, k: f"('0x' || substr({e}, {8 * k + 1}, 8))::BIGINT"
_FOLD = " || ".join(f"lpad(lower(printf('%x', xor(xor({_HALF('a', k)}, {_HALF('b', k)}), {_HALF('c', k)}))), 8, '0')" for k in (0, 1))


@query("p9_content_key", f"WITH t AS (SELECT doc_id, md5(lang) AS a, md5(text) AS b, md5(source) AS c FROM documents) SELECT doc_id, {_FOLD} AS folded, substr(b, 1, 32) AS content FROM t")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents")
    return rows.select("doc_id", identity.folded_key(F.md5("lang"), F.md5("text"), F.md5("source")).alias("folded"), identity.content_key(F.md5("text")).alias("content"))


# codec: embeddings as tensors, label the sequence, vec_id the token
ROWS_SQL = """r AS (SELECT label AS g, vec_id AS t, i - 1 AS e, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) x(i)),
    d AS (SELECT g, t, e, v, v - lag(v, 1, 0.0::DOUBLE) OVER (PARTITION BY g, e ORDER BY t) AS d FROM r)"""
SCALE_SQL = "sc AS (SELECT g, e, max(abs(d)) AS peak, max(abs(d)) / 127.0::DOUBLE AS scale FROM d GROUP BY g, e)"
QUANT_SQL = "q AS (SELECT d.g, d.t, d.e, CASE WHEN scale <> 0 THEN greatest(-127, least(127, (sign(d / scale) * floor(abs(d / scale) + 0.5))))::INT ELSE 0 END AS q FROM d JOIN sc USING (g, e))"


def _tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.channels(read_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("w3_token_delta", f"WITH {ROWS_SQL} SELECT g, t, e, d FROM d")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.token_delta(_tensor(spark, sf_dir)).select("g", "t", F.col("e").cast("bigint"), "d")


@query("a14_channel_scale", f"WITH {ROWS_SQL}, {SCALE_SQL} SELECT g, e, peak, scale FROM sc")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.channel_scales(_tensor(spark, sf_dir)).select("g", F.col("e").cast("bigint"), "peak", "scale")


@query("a15_token_scale", f"WITH {ROWS_SQL} SELECT g, t, max(abs(d)) AS peak, max(abs(d)) / 127.0::DOUBLE AS scale FROM d GROUP BY g, t")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.token_scales(_tensor(spark, sf_dir))


@query("f10_quantize", f"WITH {ROWS_SQL}, {SCALE_SQL}, {QUANT_SQL} SELECT g, t, sum(q)::BIGINT AS total, max(q) AS top FROM q GROUP BY g, t")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode_open(_tensor(spark, sf_dir)).groupBy("g", "t").agg(F.sum("q").alias("total"), F.max("q").alias("top"))


@query(
    "f11_nibbles",
    """WITH n AS (SELECT event_id, (event_id % 16 - 8)::INT AS lo, (event_id // 16 % 16 - 8)::INT AS hi FROM events)
    SELECT event_id, (lo & 15) + ((hi & 15) << 4) AS byte, lo, hi FROM n""",
)
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").selectExpr("event_id", "cast(event_id % 16 - 8 as int) AS a", "cast(event_id div 16 % 16 - 8 as int) AS b")
    packed = rows.select("event_id", codec.pack_nibbles(F.col("a"), F.col("b")).alias("byte"))
    low, high = codec.unpack_nibbles(F.col("byte"))
    return packed.select("event_id", "byte", low.alias("lo"), high.alias("hi"))


@query("f12_tensor_blob", f"""WITH {ROWS_SQL}, {SCALE_SQL}, {QUANT_SQL}, l AS (SELECT g, t, string_agg(q::VARCHAR, ',' ORDER BY e) AS line FROM q GROUP BY g, t)
    SELECT g, md5('KVT1|' || count(*) || '|64|' || string_agg(line, ';' ORDER BY t)) AS blob FROM l GROUP BY g""")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.pack_tensor(codec.encode_open(_tensor(spark, sf_dir))).select("g", F.md5("blob").alias("blob"))


_STEP = "greatest(-127, least(127, CASE WHEN s.scale <> 0 THEN sign((s.v - f.v) / s.scale) * floor(abs((s.v - f.v) / s.scale) + 0.5) ELSE 0 END))::INT"


CLOSED_SQL = fold_sql(
    f"WITH {ROWS_SQL}, {SCALE_SQL} SELECT g, t, e, g * 1000 + e AS k, r.v AS v, scale FROM r JOIN sc USING (g, e)",
    "k",
    "t",
    {"v": ("0.0::DOUBLE", f"f.v + {_STEP} * s.scale")},
    "g, t, e, f.v AS v",
)


@query("w10_closed_loop", CLOSED_SQL)
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = codec.decode(codec.encode_closed(_tensor(spark, sf_dir)))
    return decoded.select("g", "t", F.col("e").cast("bigint"), "v")


@query(
    "a23_codec_error",
    f"""WITH {ROWS_SQL} SELECT g, max(abs(r.v - w.v)) AS max_error, max(r.v) - min(r.v) AS range, round(sqrt(sum((r.v - w.v) * (r.v - w.v)) / sum(r.v * r.v)), 6) AS relative_rms
    FROM r JOIN ({CLOSED_SQL}) w USING (g, t, e) GROUP BY g""",
)
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tensor(spark, sf_dir)
    error = codec.codec_error(rows, codec.decode(codec.encode_closed(rows)))
    return error.withColumn("relative_rms", F.round("relative_rms", 6))


@query("s21_compression", "SELECT page_id, strlen(html) AS size, md5(html) AS digest FROM pages")
def s21(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    stored = read_table(spark, sf_dir, "pages").select("page_id", codec.compress(F.col("html")).alias("s"))
    return stored.select("page_id", F.col("s.size").cast("bigint").alias("size"), F.md5(codec.decompress(F.col("s"))).alias("digest"))


@query("s22_encryption", "SELECT doc_id, md5(text) AS digest, strlen(text) + 28 AS size, true AS refused FROM documents")
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the key comes from the caller; a wrong one is refused by its tag
    rows = read_table(spark, sf_dir, "documents").select("doc_id", codec.encrypt(F.col("text"), F.lit("0123456789abcdef")).alias("x"))
    right, wrong = codec.decrypt(F.col("x"), F.lit("0123456789abcdef")), codec.decrypt(F.col("x"), F.lit("fedcba9876543210"))
    return rows.select("doc_id", F.md5(right).alias("digest"), F.length("x").cast("bigint").alias("size"), wrong.isNull().alias("refused"))


@query("s25_decorator_stack", "SELECT page_id, md5(html) AS digest FROM pages")
def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # compressed first, encrypted second; read back in reverse
    key = F.lit("0123456789abcdef")
    put = read_table(spark, sf_dir, "pages").select("page_id", codec.compress(F.col("html")).alias("c"))
    stored = put.select("page_id", F.col("c.size").alias("size"), codec.encrypt(F.col("c.data"), key).alias("x"))
    opened = stored.select("page_id", F.struct("size", codec.decrypt(F.col("x"), key).alias("data")).alias("c"))
    return opened.select("page_id", F.md5(codec.decompress(F.col("c"))).alias("digest"))
