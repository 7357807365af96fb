"""Literal cases of the operators, and folds against hand-worked answers."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.api import EngineView, StateFrame
from quillstone.functions import hashing, text
from quillstone.operators import codec, ledger, membership, metrics, prefix, qos, routing, security, sketch, tiers
from quillstone.operators.fold import ordered_fold
from quillstone.plans import ORACLES, QUERIES
from quillstone.session import BATCH_ROWS
from quillstone.sources import tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_fnv_vectors(spark):
    given = ["", "a", "llama-3-8b", "mistral-7b-instruct"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    got = [r[1] for r in sorted(rows(df.select("i", hashing.fnv1a64(F.col("s")))))]
    assert got == ["cbf29ce484222325", "af63dc4c8601ec8c", "2154ed5dc3aa6e7b", "4cdeeea8ec431068"]
    zeros = spark.range(1).select(hashing.fnv1a64(F.unhex(F.lit("00" * 16))))
    assert rows(zeros) == [("88201fb960ff6465",)]
    assert rows(spark.createDataFrame([(None,)], "s string").select(hashing.fnv1a64(F.col("s")))) == [(None,)]


def test_chunks(spark):
    df = spark.createDataFrame([(1, [7] * 40), (2, []), (3, [7] * 16), (4, [7] * 16)], "id int, t array<bigint>")
    got = dict(rows(df.select("id", prefix.chunk_hashes(F.col("t").cast("array<string>")))))
    assert [len(got[i]) for i in (1, 2, 3)] == [2, 0, 1]
    assert got[3] == got[4]


def test_longest_prefix(spark):
    base = [str(i) for i in range(32)]
    sealed = spark.createDataFrame([(10, base), (11, base[:16])], "id bigint, t array<string>")
    asked = spark.createDataFrame([(1, base + ["x"] * 32), (2, base[:31]), (3, base[:15]), (4, None), (5, [])], "id bigint, t array<string>")
    ns = prefix.namespace(F.lit("a"), F.lit("m"))
    index = prefix.sealed_index(prefix.paths(sealed, "id", ns, F.col("t")), "id")
    got = {r[0]: r[1:] for r in rows(prefix.longest_prefix_match(asked, "id", ns, F.col("t"), index))}
    assert got == {1: (32, 10), 2: (16, 11), 3: (0, None), 4: (0, None), 5: (0, None)}
    other = prefix.longest_prefix_match(asked, "id", prefix.namespace(F.lit("a"), F.lit("n")), F.col("t"), index)
    assert all(r[1] == 0 for r in rows(other))


def test_state_frame(spark, tmp_path):
    frame = StateFrame(spark, str(tmp_path / "state"))
    tokens = [str(i) for i in range(35)]
    payload = bytes(7 * i % 256 for i in range(35 * 64))
    schema = "id bigint, tenant string, model string, tokens array<string>, payload binary"
    ask = spark.createDataFrame([(9, "t", "m", tokens + ["x"] * 3, None), (8, "t", "other", tokens, None)], schema)
    assert {r[0]: r[1] for r in rows(frame.lookup(ask))} == {9: 0, 8: 0}
    engine = EngineView(frame, "tgi")
    status = engine.insert(spark.createDataFrame([(1, "t", "m", tokens, bytearray(payload)), (2, "t", "m", tokens[:9], bytearray(b"z"))], schema))
    assert dict(rows(status)) == {1: "OK", 2: "INVAL"}
    got = {r[0]: r[1:] for r in rows(engine.load(ask))}
    assert got[9][:2] == (32, 1) and bytes(got[9][2]) == payload[: 32 * 64]
    assert got[8] == (0, None, None)
    assert dict(rows(frame.stored_bytes(ask))) == {9: 2048, 8: 0}
    assert engine.evict(ask) is False


def test_bloom(spark):
    m, k = sketch.bloom_params(1024, 0.01)
    assert m % 64 == 0 and k == 7 and sketch.bloom_params(0, 2.0) == sketch.bloom_params(1, 0.01)
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    m, k = sketch.bloom_params(2000, 0.01)
    merged = sketch.merge_sketches(sketch.build_sketch(keys, F.lit("n"), F.col("key"), m, k), m, k)
    probes = spark.range(100000, 105000).union(spark.range(2000)).select("id", F.col("id").cast("string").alias("key"))
    got = rows(sketch.maybe_contains(probes, "id", F.col("key"), merged, m, k))
    assert all(hit for i, hit in got if i < 2000)
    assert sum(hit for i, hit in got if i >= 2000) <= 250


def test_hrw(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 0.0)], "id string, w double")
    array = routing.node_array(nodes, "id", "w")
    keys = spark.range(400).select(F.col("id").cast("string").alias("key"))
    got = [r[1] for r in rows(routing.hrw_primary(keys, F.col("key"), array))]
    assert 120 < got.count("a") < 280 and "c" not in got
    top = rows(routing.hrw_top_k(keys.limit(1), F.col("key"), array, 5))
    assert [r[1] for r in top] == [1, 2, 3] and top[2][2] == "c"
    none = routing.node_array(nodes.filter("w > 5"), "id", "w")
    assert {r[1] for r in rows(routing.hrw_primary(keys, F.col("key"), none))} == {None}


def test_queue_places(spark):
    ops = ["lookup", "insert", "lookup", "insert", "lookup", "erase", "lookup", "insert", "erase"]
    df = spark.createDataFrame([("a", i, o) for i, o in enumerate(ops)], "key string, seq bigint, op string")
    got = [r["where"] for r in tiers.queue_places(df, ["key"], ["seq"]).orderBy("seq").collect()]
    assert got == ["miss", "miss", "first", "first", "main", "main", "miss", "miss", "first"]


def test_backlog_starts_anew_when_a_reader_found_nothing(spark):
    df = spark.createDataFrame([("s", i, d) for i, d in enumerate([0, 0, 9, 0, 1])], "who string, seq bigint, drained bigint")
    got = [(r.depth, r.over) for r in qos.backlog(df, "who", ["seq"], 1).orderBy("seq").collect()]
    assert got == [(1, False), (2, True), (1, False), (2, True), (2, True)]


def admit(spark, requests, capacity, qps, bps, inflated=False):
    schema = "tenant string, seq bigint, ts_ms bigint, bytes bigint, requests bigint, bandwidth bigint, released bigint"
    asked = spark.createDataFrame([("t", i, *r) for i, r in enumerate(requests)], schema)
    limits = spark.createDataFrame([("t", capacity, qps, bps, inflated)], "tenant string, capacity bigint, qps bigint, bps bigint, inflated boolean")
    return [r.result for r in qos.admit(asked, limits).orderBy("seq").collect()]


def test_quota(spark):
    assert admit(spark, [(0, 60, 1, 0, 0), (0, 40, 1, 0, 0), (0, 1, 1, 0, 0)], 100, 0, 0) == ["ok", "ok", "capacity"]
    assert admit(spark, [(0, 0, 1, 0, 0)] * 4, 0, 3, 0) == ["ok"] * 3 + ["qps"]
    assert admit(spark, [(0, 0, 1, 80, 0), (0, 0, 1, 25, 0), (1500, 0, 1, 25, 0)], 0, 0, 100) == ["ok", "bandwidth", "ok"]
    assert admit(spark, [(0, 150, 1, 0, 0), (0, 1, 1, 0, 0)], 100, 0, 0, True) == ["ok", "capacity"]
    assert admit(spark, [(0, 100, 1, 0, 0), (0, 0, 0, 0, 50), (0, 50, 1, 0, 0)], 100, 0, 0) == ["ok", "released", "ok"]
    unknown = spark.createDataFrame([("u", 0, 0, 1, 1, 1, 0)], "tenant string, seq bigint, ts_ms bigint, bytes bigint, requests bigint, bandwidth bigint, released bigint")
    none = spark.createDataFrame([], "tenant string, capacity bigint, qps bigint, bps bigint, inflated boolean")
    assert qos.admit(unknown, none).collect()[0].result == "unknown_tenant"


def test_membership(spark):
    steps = ["active", "active", "joining", "draining", "unreachable", "joining", "active", "draining", "terminated", "joining"]
    df = spark.createDataFrame([("n", i, s) for i, s in enumerate(steps)], "node string, seq bigint, target string")
    got = [(r.state, r.result) for r in membership.membership(df, "node", "seq", "target").orderBy("seq").collect()]
    assert [r for _, r in got] == ["ok", "same", "illegal", "ok", "ok", "ok", "ok", "ok", "ok", "illegal"]
    assert got[-1][0] == "terminated"


def test_histogram_bounds(spark):
    df = spark.createDataFrame([("x", v) for v in (0.5, 3.0, 8.0, 20.0, 1.0)], "l string, v double")
    got = {r.le: r["count"] for r in metrics.histogram(df, ["l"], "v", [1.0, 5.0, 10.0]).collect()}
    assert got == {"1.0": 1, "5.0": 3, "10.0": 4, "+Inf": 5}
    assert metrics.histogram(df.limit(0), ["l"], "v", [1.0]).count() == 0


def test_summary_and_fairness(spark):
    df = spark.createDataFrame([("x", v) for v in range(100)], "l string, v bigint")
    r = metrics.latency_summary(df, ["l"], "v").collect()[0]
    assert (r.n, r.min, r.max, r.p50, r.p95, r.p99, r.p999) == (100, 0, 99, 50, 95, 99, 99)
    even = spark.createDataFrame([("x", 5), ("y", 5)], "l string, v bigint")
    assert metrics.jain_fairness(even, [], "v").collect()[0][0] == 1.0


def test_prometheus(spark):
    lines = ['a{b="c d"} 3', "a 1.5", "", "# HELP a", "broken", "a x"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted(rows(metrics.parse_prometheus(df))) == [("a", 1.5), ('a{b="c d"}', 3.0)]


def test_torn_log(spark):
    df = spark.createDataFrame([("s", 1, "k", "a", True), ("s", 2, "k", "b", True), ("s", 3, "k", "c", False), ("s", 4, "k", "d", True)], "s string, seq int, key string, v string, ok boolean")
    kept = ledger.valid_prefix(df, ["s"], ["seq"], F.col("ok"))
    assert rows(ledger.latest(kept, ["key"], ["seq"], ["v"])) == [("k", "b")]


def test_checksum_of_many_rows(spark):
    """Totals beyond a long wrap around: 48-bit numbers of 300,000 rows, and the sum by hand."""
    n = 300_000
    total = sum(int(hashlib.sha256(f"{i}|{i % 7}".encode()).hexdigest()[:12], 16) for i in range(n))
    assert total >= 1 << 64
    df = spark.range(n).select("id", (F.col("id") % 7).alias("k"), F.lit("g").alias("g"))
    assert rows(ledger.table_checksum(df, ["id", "k"], ["g"])) == [("g", n, (total + (1 << 63)) % (1 << 64) - (1 << 63))]
    assert dict(ledger.table_checksum(df, ["id", "k"], ["g"]).dtypes)["checksum"] == "bigint"


@pytest.mark.parametrize(
    "host, glob, fits",
    [("a.x.com", "*.x.com", True), ("x.com", "*.x.com", False), ("X.com.", "x.COM", True), ("", "*", False), ("ax.com", "*.x.com", False), ("a", "", False)],
)
def test_host_glob(spark, host, glob, fits):
    assert rows(spark.range(1).select(security.host_matches(F.lit(host), F.lit(glob)))) == [(fits,)]


@pytest.mark.parametrize(
    "ip, net, inside",
    [("10.1.2.3", "10.0.0.0/8", True), ("11.1.2.3", "10.0.0.0/8", False), ("1.2.3.4", "0.0.0.0/0", True), ("256.1.1.1", "0.0.0.0/0", False), ("1.2.3", "1.2.3.0/24", False), ("1.2.3.4", "1.2.3.4/33", False), ("1.2.3.4", "1.2.3.4", False), ("1.2.3.4", "1.2.3.4/32", True)],
)
def test_cidr(spark, ip, net, inside):
    assert rows(spark.range(1).select(security.ip_in_cidr(F.lit(ip), F.lit(net)))) == [(inside,)]


def test_certificates(spark):
    certs = spark.createDataFrame([(1, "spiffe://td/a", "n"), (2, "spiffe://other/a", "n"), (3, "bad", "n"), (4, "spiffe://td/zz", "n"), (5, None, "n"), (6, None, "")], "i int, spiffe_id string, cn string")
    by_id = spark.createDataFrame([("spiffe://td/a", "I"), ("spiffe://other/a", "O"), ("bad", "B")], "spiffe_id string, identity string")
    by_cn = spark.createDataFrame([("n", "N")], "cn string, identity string")
    got = {r.i: r.identity for r in security.resolve_certificates(certs, by_id, by_cn, "td").collect()}
    assert got == {1: "I", 2: None, 3: "N", 4: "N", 5: "N", 6: None}


def test_codec_bounds(spark):
    smooth = spark.createDataFrame([("g", t, e, float((t + e) % 9) * 10 ** ((e % 5) - 2)) for t in range(40) for e in range(10)], "g string, t bigint, e int, v double")
    for bits, bound in ((8, 0.02), (4, 0.25)):
        r = codec.codec_error(smooth, codec.decode(codec.encode_closed(smooth, bits))).collect()[0]
        assert r.relative_rms < bound
    zeros = smooth.withColumn("v", F.lit(0.0))
    assert codec.codec_error(zeros, codec.decode(codec.encode_closed(zeros))).collect()[0].max_error == 0


@pytest.mark.parametrize("name", ["s21_compression", "s25_decorator_stack", "x4_storage_stack"])
def test_compressed_rows_go_to_python_a_few_at_a_time(spark, sf_dir, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10000)
        QUERIES[name](spark, sf_dir)
        assert int(spark.conf.get(key)) <= BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def test_nibbles_and_rounding(spark):
    df = spark.createDataFrame([(a, b) for a in (-8, -1, 0, 7) for b in (-8, -1, 0, 7)], "a int, b int")
    low, high = codec.unpack_nibbles(codec.pack_nibbles(F.col("a"), F.col("b")))
    assert all(r[0] == r[2] and r[1] == r[3] for r in rows(df.select("a", "b", low, high)))
    got = rows(spark.createDataFrame([(2.5,), (-2.5,), (400.0,), (-400.0,)], "v double").select(codec.quantize(F.col("v"), F.lit(1.0))))
    assert [r[0] for r in got] == [3, -3, 127, -127]


def test_powers_and_urls(spark):
    df = spark.createDataFrame([(0,), (8,), (9,), (1025,)], "n bigint")
    assert [r[0] for r in rows(df.select(text.next_power_of_two(F.col("n"))))] == [8, 8, 16, 2048]
    assert rows(spark.range(1).select(text.url_encode(F.lit("a b*~/é")))) == [("a%20b%2A~%2F%C3%A9",)]


NANOS = [0, 1, 999_999, 2_545_151_017_816_057, 9_223_372_036_853_999_999, 9_223_372_036_854_000_000, -1, None]


def by_hand(n):
    ms = n // 1_000_000 % 86_400_000
    return f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}.{ms % 1000:03}"


def test_clock_of_long_nanos(spark):
    """A nanosecond before and after a whole millisecond, where a double can't tell them apart."""
    df = spark.createDataFrame([(n,) for n in NANOS], "n bigint")
    assert [r[0] for r in rows(df.select(text.clock(F.col("n"))))] == [None if n is None else by_hand(n) if n else "-" for n in NANOS]


def test_event_line_of_long_nanos(spark):
    df = spark.createDataFrame([(n,) for n in NANOS if n], "n bigint")
    line = text.event_line(text.clock(F.col("n")), F.lit("KV_EVENT_ADD"), F.lit(3))
    assert [r[0] for r in rows(df.select(line))] == [f"{by_hand(n)} ADD epoch=3" for n in NANOS if n]


def test_last_half_millisecond_of_an_hour_is_the_next_one(spark, tmp_path):
    """As the SQL has it: epoch_ms rounds half away from zero."""
    micros = [0, 3_599_999_499, 3_599_999_500, -3_600_000_499, -3_599_999_500, -3_599_999_499, None]
    df = spark.createDataFrame([(i, m, i, "view") for i, m in enumerate(micros)], "event_id bigint, m bigint, user_id bigint, event_type string")
    df = df.withColumn("ts", F.timestamp_micros("m").cast("timestamp_ntz"))
    assert [r[0] for r in rows(df.select(text.epoch_millis(F.col("ts"))))] == [0, 3_599_999, 3_600_000, -3_600_000, -3_600_000, -3_599_999, None]
    df.filter("m IS NOT NULL").drop("m").write.parquet(f"{tmp_path}/events.parquet")
    sql = ORACLES["t10_class_load"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["t10_class_load"](spark, str(tmp_path)).select("tenant", "class", "hour", "submitted", "finished", "in_flight")
    assert sorted(rows(got)) == sorted(duckdb.sql(sql).fetchall())


#: About where the queries' nanoseconds leave a BIGINT, at 60 times sf0.1, and far beyond.
LARGE_IDS = [0, 1, 1_164_714, 1_164_715, 1_164_750, 5_999_999, 2**40 + 1, 2**63 - 1, None]


def clock_by_hand(i):
    return None if i is None else by_hand((i * 7919 + 13) * 1_000_000_007) if i % 50 else "-"


def test_clock_of_large_ids(spark, tmp_path):
    spark.createDataFrame([(i,) for i in LARGE_IDS], "event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["at"] for r in QUERIES["f8_clock"](spark, str(tmp_path)).collect()}
    assert got == {i: clock_by_hand(i) for i in LARGE_IDS}


def test_event_line_of_large_ids(spark, tmp_path):
    spark.createDataFrame([(i, "add") for i in LARGE_IDS], "event_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = [r["line"] for r in QUERIES["f9_event_line"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([None if i is None else f"{clock_by_hand(i)} ADD epoch={i}" for i in LARGE_IDS], key=str)


def test_fold_keeps_order_and_empty(spark):
    df = spark.createDataFrame([(k, i) for k in range(3) for i in range(5000)], "k int, i int").repartition(7)

    def step(state, r):
        state.append(r["i"])
        yield r["k"], r["i"], len(state)

    got = ordered_fold(df, ["k"], ["i"], list, step, "k int, i int, n int")
    assert got.filter("n <> i + 1").count() == 0 and got.count() == 15000
    assert ordered_fold(df.limit(0), ["k"], ["i"], list, step, "k int, i int, n int").count() == 0


def test_registry_snapshot(spark, tmp_path):
    lines = ['{"key":"/n/a","value":"1","revision":1}', '{"key":"/n/a","value":"2","revision":2}', '{"key":"/x","value":"3","revision":1}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    assert rows(tables.registry_snapshot(spark, str(tmp_path / "r.json"), "/n/")) == [("/n/a", "2", 2)]


def test_stream_replication_is_idempotent(spark, tmp_path):
    from quillstone.streaming import feeds

    schema = "stream string, key string, type string, tier int, epoch bigint"
    feed_dir, out = str(tmp_path / "feed"), str(tmp_path / "out")
    primary = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, payload string")
    spark.createDataFrame([("s", "a", "ADD", 1, 1), ("s", "b", "ADD", 5, 2), ("s", "gone", "ADD", 1, 3), ("s", "b", "EVICT", 1, 4)], schema).write.parquet(feed_dir)
    stream = lambda: feeds.events(spark, feed_dir, spark.read.parquet(feed_dir).schema)
    feeds.replicate(stream(), primary, out)()
    spark.createDataFrame([("s", "a", "ADD", 1, 1), ("s", "b", "ADD", 1, 5), ("s", "a", "ADD", 1, 0)], schema).write.mode("append").parquet(feed_dir)
    feeds.replicate(stream(), primary, out)()
    assert sorted((r.key, r.epoch) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 5)]


def test_fold_of_a_stream_keeps_state_between_batches(spark, tmp_path):
    from quillstone.operators.fold import Fold
    from quillstone.streaming import feeds

    path = str(tmp_path / "feed")
    for part in range(3):
        spark.createDataFrame([("k", part * 10 + i) for i in range(10)], "k string, i int").coalesce(1).write.mode("append").parquet(path)

    def step(state, r):
        state.append(r["i"])
        yield r["k"], r["i"], len(state)

    fold = Fold(["k"], ["i"], list, step, "k string, i int, n int")
    got = feeds.run_to_end(feeds.folded(feeds.events(spark, path, spark.read.parquet(path).schema, files_per_trigger=1), fold))
    assert sorted(r.n for r in got.collect()) == list(range(1, 31))


def test_context_protocol(spark):
    from quillstone.operators import requests

    ops = [("fetch", 0), ("publish", 5), ("reserve", 0), ("reserve", 0), ("seal", 0), ("publish", 8), ("publish", 3), ("fetch", 0), ("seal", 0), ("publish", 9), ("seal", 0), ("fetch", 0), ("release", 0), ("fetch", 0), ("release", 0), ("reserve", 0), ("seal", 0)]
    df = spark.createDataFrame([("h", i, *o) for i, o in enumerate(ops)], "handle string, seq int, op string, watermark int")
    got = [r.status for r in requests.context_protocol(df, "handle", "seq").orderBy("seq").collect()]
    assert got == ["not_found", "unknown", "ok", "busy", "empty", "ok", "stale", "not_found", "ok", "sealed", "sealed", "ok", "ok", "not_found", "unknown", "ok", "empty"]


def test_request_lifecycle(spark):
    from quillstone.operators import requests

    asked = spark.createDataFrame([(1, 10, 9999), (2, 0, 5), (3, 0, 99), (4, 0, 99)], "id int, computed int, asked_bytes int")
    matches = spark.createDataFrame([(1, 16), (2, 16), (3, 0), (4, 16)], "id int, matched_tokens int")
    layers = spark.createDataFrame([(1, 0, 7, 0), (1, 0, 9, 1), (1, 1, 1, 0), (2, 0, 3, 0)], "id int, layer int, bytes int, n int")
    rows = requests.request_lifecycle(asked, matches, layers, asked.filter("id = 4").select("id"), 2, 4).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 6, 64, True, 10, True), (2, 16, 0, False, 3, False), (3, 0, 0, False, 0, False)]
