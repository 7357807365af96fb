"""Queries of access and boundaries: pages give hosts, customers tenants, events requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import security as op
from quillstone.plans.registry import query
from quillstone.session import read_table

REQUEST = {
    "kind": "CASE user_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'internal' WHEN 2 THEN 'unknown' ELSE 'tenant' END",
    "action": "CASE event_id % 9 WHEN 0 THEN 'lookup' WHEN 1 THEN 'reserve' WHEN 2 THEN 'publish' WHEN 3 THEN 'fetch' WHEN 4 THEN 'seal' WHEN 5 THEN 'release' WHEN 6 THEN 'admin_read' WHEN 7 THEN 'admin_write' ELSE 'other' END",
    "own": "user_id % 20",
    "target": "CASE WHEN event_id % 4 = 0 THEN event_id % 20 ELSE user_id % 20 END",
    "deleting": "user_id % 13 = 5",
}
REQUEST_SQL = "r AS (SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in REQUEST.items()) + " FROM events)"


@query(
    "p13_rbac",
    f"""WITH {REQUEST_SQL} SELECT event_id, CASE WHEN kind = 'unknown' THEN 'deny'
    WHEN action IN ('lookup', 'reserve', 'publish', 'fetch', 'seal', 'release') AND kind NOT IN ('tenant', 'internal') THEN 'deny'
    WHEN action IN ('admin_read', 'admin_write', 'cluster_admin') AND kind <> 'admin' THEN 'deny' WHEN action = 'other' THEN 'deny'
    WHEN kind = 'tenant' AND own <> target THEN 'deny' WHEN deleting AND action IN ('reserve', 'publish', 'seal') THEN 'deny' ELSE 'allow' END AS decision FROM r""",
)
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "events").select("event_id", *[F.expr(v).alias(k) for k, v in REQUEST.items()])
    return r.select("event_id", op.rbac_decision(*[F.col(k) for k in REQUEST]).alias("decision"))


HOST_SQL = "regexp_extract(url, '^https?://([^/]+)', 1)"
GLOBS = ["*.example.org", "m.*", "*.example.com.", "EXAMPLE.net", "*"]
_GLOB_SQL = """CASE WHEN starts_with(g, '*') THEN ends_with(h, substr(g, 2)) AND length(h) > length(g) - 1 ELSE h = g END"""


@query(
    "p14_host_glob",
    f"""WITH gs(pattern) AS (VALUES {", ".join(f"('{g}')" for g in GLOBS)}),
    n AS (SELECT page_id, pattern, regexp_replace(lower({HOST_SQL}), '\\.$', '') AS h, regexp_replace(lower(pattern), '\\.$', '') AS g FROM pages, gs)
    SELECT page_id, pattern, {_GLOB_SQL} AS fits FROM n""",
)
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = op.url_host(F.col("url"))["host"]
    rows = read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.explode(F.array(*map(F.lit, GLOBS))).alias("pattern"))
    return rows.select("page_id", "pattern", op.host_matches(F.col("host"), F.col("pattern")).alias("fits"))


IP = "(c_custkey % 3 + 9) || '.' || (c_custkey % 300) || '.' || (c_nationkey) || '.' || (c_custkey % 256)"
NETS = ["10.0.0.0/8", "9.1.0.0/16", "10.128.0.0/9", "11.7.0.0/33", "0.0.0.0/0"]
_NUM = lambda parts: f"{parts}[1]::BIGINT * 16777216 + {parts}[2]::BIGINT * 65536 + {parts}[3]::BIGINT * 256 + {parts}[4]::BIGINT"


@query(
    "p15_ip_in_cidr",
    f"""WITH n(net) AS (VALUES {", ".join(f"('{n}')" for n in NETS)}),
    x AS (SELECT c_custkey, net, string_split({IP}, '.') AS a, string_split(split_part(net, '/', 1), '.') AS b, split_part(net, '/', 2)::INT AS w FROM customer, n),
    y AS (SELECT c_custkey, net, w, CASE WHEN a[2]::INT <= 255 THEN {_NUM('a')} END AS ip, {_NUM('b')} AS base FROM x)
    SELECT c_custkey, net, coalesce(w <= 32 AND ip // (1::BIGINT << greatest(32 - w, 0)) = base // (1::BIGINT << greatest(32 - w, 0)), false) AS inside FROM y""",
)
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.expr(IP).alias("ip"), F.explode(F.array(*map(F.lit, NETS))).alias("net"))
    return rows.select("c_custkey", "net", op.ip_in_cidr(F.col("ip"), F.col("net")).alias("inside"))


MIXED_URL = "CASE page_id % 5 WHEN 0 THEN replace(url, '.example', '.example:x') WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN replace(url, '://', '://u@') WHEN 3 THEN replace(replace(url, '.com/', '.com:8080/'), '.net/', '.net:70000/') ELSE url END"
HOST_PORT_SQL = f"""u AS (SELECT page_id, {MIXED_URL} AS url FROM pages),
    a AS (SELECT page_id, url, regexp_replace({HOST_SQL}, '^.*@', '') AS authority FROM u),
    p AS (SELECT page_id, split_part(authority, ':', 1) AS host, CASE WHEN NOT contains(authority, ':') THEN CASE WHEN starts_with(url, 'https:') THEN 443 ELSE 80 END
          ELSE try_cast(nullif(regexp_extract(authority, '^[^:]*:([0-9]{{1,5}})$', 1), '') AS INT) END AS port FROM a),
    hp AS (SELECT page_id, CASE WHEN host <> '' AND coalesce(port BETWEEN 1 AND 65535, false) THEN host ELSE '' END AS host,
           CASE WHEN host <> '' AND coalesce(port BETWEEN 1 AND 65535, false) THEN port ELSE 0 END AS port FROM p)"""


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read_table(spark, sf_dir, "pages").select("page_id", F.expr(MIXED_URL).alias("url"))
    return urls.select("page_id", op.url_host(F.col("url")).alias("u")).select("page_id", "u.host", "u.port")


@query("p16_url_host_port", f"WITH {HOST_PORT_SQL} SELECT page_id, host, port FROM hp")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hosts(spark, sf_dir)


RULES: list[tuple[str | None, str]] = [("metrics", "*.example.org"), (None, "*.example.net"), ("traces", "10.0.0.0/8")]
PURPOSE = "CASE page_id % 2 WHEN 0 THEN 'metrics' ELSE 'traces' END"
BOUNDARY_SQL = f"""{HOST_PORT_SQL}, bc AS (SELECT page_id, host, {PURPOSE} AS purpose,
    CASE WHEN host = '' THEN 'empty host' WHEN ({PURPOSE} = 'metrics' AND lower(host) LIKE '_%.example.org') OR lower(host) LIKE '_%.example.net' THEN '' ELSE 'not allowed' END AS reason FROM hp)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hosts(spark, sf_dir).withColumn("purpose", F.expr(PURPOSE))
    return rows.select("page_id", "purpose", op.boundary_check(F.col("host"), F.col("purpose"), RULES).alias("b")).select("page_id", "purpose", "b.*")


@query("p17_boundary_check", f"WITH {BOUNDARY_SQL} SELECT page_id, purpose, reason = '' AS allow, reason FROM bc")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


@query("s24_guarded_sink", f"WITH {BOUNDARY_SQL} SELECT page_id FROM bc WHERE reason = ''")
def s24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).filter("allow").select("page_id")


@query("t20_deny_observer", f"WITH {BOUNDARY_SQL} SELECT purpose, reason, count(*) AS denied FROM bc WHERE reason <> '' GROUP BY ALL")
def t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.denials(_checked(spark, sf_dir), ["purpose", "reason"])


@query(
    "p18_regulated_mode",
    f"""WITH {BOUNDARY_SQL}, g AS (SELECT page_id // 10 AS config, arg_min(reason, page_id) FILTER (reason <> '') AS reason FROM bc GROUP BY 1)
    SELECT config, reason IS NULL AS valid, coalesce(reason, '') AS reason FROM g""",
)
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checked(spark, sf_dir).select(F.expr("page_id div 10").alias("config"), "page_id", F.col("allow").alias("passed"), "reason")
    return op.regulated_mode(checks, ["config"], "page_id")


SPIFFE = """CASE c_custkey % 8 WHEN 0 THEN 'spiffe://' || 'td' || c_custkey % 3 WHEN 1 THEN 'spiffe://td1/' WHEN 2 THEN 'http://x/tenant/a'
 WHEN 3 THEN 'spiffe://td0/tenant/' || c_custkey || '/x' WHEN 4 THEN 'spiffe://td1/node/n' || c_custkey WHEN 5 THEN 'spiffe://td0/cp' WHEN 6 THEN 'spiffe://td0/kvagent' ELSE 'spiffe://td2/a/tenant/t' || c_nationkey END"""
PARSED_SQL = f"""c AS (SELECT c_custkey, {SPIFFE} AS uri FROM customer),
    x AS (SELECT c_custkey, uri, regexp_extract(uri, '^spiffe://([^/]+)(/.*)?$', 1) AS td, regexp_extract(uri, '^spiffe://([^/]+)(/.*)?$', 2) AS path FROM c),
    s AS (SELECT c_custkey, uri, CASE WHEN td <> '' AND path <> '/' THEN td END AS td, CASE WHEN td <> '' AND path <> '/' THEN path END AS path FROM x)"""


def _certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.expr(SPIFFE).alias("spiffe_id"))


@query("p19_spiffe_parse", f"WITH {PARSED_SQL} SELECT c_custkey, td AS trust_domain, path, nullif(regexp_extract(path, '/tenant/([^/]*)', 1), '') AS tenant FROM s")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = op.spiffe(F.col("spiffe_id"))
    return _certs(spark, sf_dir).select("c_custkey", parsed["trust_domain"].alias("trust_domain"), parsed["path"].alias("path"), op.spiffe_tenant(F.col("spiffe_id")).alias("tenant"))


@query(
    "p20_workload_identity",
    f"""WITH {PARSED_SQL}, k AS (SELECT c_custkey, td, regexp_extract(path, '^/([^/]+)', 1) AS kind, regexp_extract(path, '^/[^/]+/(.*)$', 1) AS id FROM s)
    SELECT c_custkey, kind, id FROM k WHERE kind IN ('node', 'cp', 'kvagent') AND (kind = 'cp' OR id <> '') AND td = 'td0'
    UNION ALL SELECT c_custkey, NULL, NULL FROM k WHERE NOT coalesce(kind IN ('node', 'cp', 'kvagent') AND (kind = 'cp' OR id <> '') AND td = 'td0', false)""",
)
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.workload(F.col("spiffe_id"), "td0")
    return _certs(spark, sf_dir).select("c_custkey", found["kind"].alias("kind"), found["id"].alias("id"))


CN = "CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'cn' || c_nationkey END"
RESOLVED_SQL = f"""{PARSED_SQL}, w AS (SELECT s.*, {CN} AS cn, c_custkey % 2 = 0 AS mapped, c_nationkey FROM s JOIN customer USING (c_custkey)),
    i AS (SELECT c_custkey, uri, cn, path, CASE WHEN td IS NOT NULL AND td = 'td2' THEN NULL ELSE coalesce(CASE WHEN td IS NOT NULL THEN m.identity END, CASE WHEN cn <> '' AND w.c_nationkey < 12 THEN 'by-' || cn END) END AS identity
          FROM w LEFT JOIN (SELECT uri, 'id-' || min(c_custkey) AS identity FROM c WHERE c_custkey % 2 = 0 GROUP BY uri) m USING (uri))"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    certs = _certs(spark, sf_dir).withColumn("cn", F.expr(CN))
    table = certs.filter("c_custkey % 2 = 0").groupBy("spiffe_id").agg(F.concat(F.lit("id-"), F.min("c_custkey")).alias("identity"))
    names = certs.filter("cn <> '' AND c_nationkey < 12").select("cn", F.concat(F.lit("by-"), "cn").alias("identity")).distinct()
    # two trust domains are at home here, each with its own certificates
    second = F.startswith("spiffe_id", F.lit("spiffe://td1"))
    rows = op.resolve_certificates(certs.filter(~second), table, names, "td0")
    return rows.unionByName(op.resolve_certificates(certs.filter(second), table, names, "td1"))


@query("j14_certificate_identity", f"WITH {RESOLVED_SQL} SELECT c_custkey, identity FROM i")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("c_custkey", "identity")


@query("j15_tenant_resolution", f"WITH {RESOLVED_SQL} SELECT c_custkey, coalesce(nullif(identity, ''), nullif(regexp_extract(path, '/tenant/([^/]*)', 1), ''), nullif(cn, '')) AS tenant FROM i")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.resolve_tenants(_resolved(spark, sf_dir)).select("c_custkey", "tenant")


TENANT = {
    "tenant_id": "CASE c_custkey % 7 WHEN 1 THEN 'xyz' ELSE md5(c_name) END",
    "capacity": "CASE c_custkey % 11 WHEN 1 THEN '10Q' WHEN 2 THEN '1.5Gi' ELSE '100M' END",
    "bandwidth": "CASE c_custkey % 13 WHEN 1 THEN '' ELSE '2e3' END",
    "qps": "c_custkey % 17",
    "priority": "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'P9' ELSE 'P1' END",
    "cluster": "CASE WHEN c_custkey % 19 = 0 THEN '' ELSE 'c' || c_nationkey END",
}
ID_CN = "CASE c_custkey % 6 WHEN 0 THEN '' ELSE 'n' END"
ID_KIND = "CASE c_custkey % 4 WHEN 0 THEN 'boss' ELSE 'tenant' END"
ID_URI = "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'spiffe://a/b' ELSE 'x' END"


@query(
    "p26_tenant_validation",
    "WITH t AS (SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in TENANT.items()) + f""", {ID_CN} AS cn, {ID_KIND} AS kind, {ID_URI} AS uri FROM customer)
    SELECT c_custkey, CASE WHEN length(tenant_id) <> 32 THEN 'InvalidTenantID' WHEN capacity = '10Q' OR bandwidth = '' OR qps = 0 THEN 'InvalidQuota'
    WHEN priority = 'P9' THEN 'InvalidPriority' WHEN cluster = '' THEN 'MissingClusterRef'
    WHEN cluster NOT IN (SELECT 'c' || n_nationkey FROM nation WHERE n_regionkey <> 2) THEN 'ClusterNotFound'
    WHEN (uri = '' AND cn = '') OR uri = 'x' OR kind = 'boss' THEN 'InvalidIdentity' ELSE '' END AS reason FROM t""",
)
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = F.struct(F.expr(ID_URI).alias("spiffe_id"), F.expr(ID_CN).alias("cn"), F.expr(ID_KIND).alias("kind"))
    tenants = read_table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(v).alias(k) for k, v in TENANT.items()], F.array(identity).alias("identities"))
    clusters = read_table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.concat(F.lit("c"), "n_nationkey").alias("cluster"))
    return op.validate_tenants(tenants, clusters).select("c_custkey", "reason")


@query("j21_cluster_reference", "SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) AS found FROM customer")
def j21(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read_table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(True).alias("f"))
    rows = read_table(spark, sf_dir, "customer").join(known, "c_nationkey", "left")
    return rows.select("c_custkey", F.col("f").isNotNull().alias("found"))


ENTRY = """'{"spiffe_id":"' || CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'spiffe://a/' || c_custkey END || '","cn":"' || CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'n' || c_custkey END || '","kind":"' || CASE c_custkey % 5 WHEN 0 THEN 'boss' ELSE 'tenant' END || '"}'"""


@query(
    "p33_identity_entries",
    f"""WITH e AS (SELECT ({ENTRY})::JSON AS j FROM customer) SELECT j->>'spiffe_id' AS spiffe_id, j->>'cn' AS cn,
    CASE WHEN j->>'kind' IN ('tenant', 'internal', 'admin') THEN j->>'kind' ELSE 'unknown' END AS kind FROM e WHERE j->>'spiffe_id' <> '' OR j->>'cn' <> ''""",
)
def p33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.identity_entries(read_table(spark, sf_dir, "customer").select(F.expr(ENTRY).alias("body")), "body")


@query(
    "u3_identity_reconcile",
    """WITH d AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0), e AS (SELECT c_custkey AS k, c_nationkey - (c_custkey % 5 = 0)::INT AS v FROM customer WHERE c_custkey % 4 <> 0)
    SELECT k, CASE WHEN d.v IS NULL THEN 'delete' ELSE 'put' END AS action FROM d FULL JOIN e USING (k) WHERE d.v IS NULL OR e.v IS NULL OR d.v <> e.v""",
)
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    have = rows.filter("k % 4 <> 0").withColumn("v", F.col("v") - (F.col("k") % 5 == 0).cast("int"))
    return op.reconcile(rows.filter("k % 3 <> 0"), have, "k", "v")


TOKENS = "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '*.h' || s_suppkey WHEN 2 THEN '10.' || s_nationkey || '.0.0/16' ELSE 'a/b' || s_suppkey END"


@query(
    "u5_rule_build",
    f"""WITH t AS (SELECT s_suppkey AS ordinal, {TOKENS} AS t FROM supplier WHERE {TOKENS} <> '')
    SELECT ordinal, CASE WHEN NOT regexp_matches(t, '^[^/]*/[0-9]+$') THEN t END AS host_glob, CASE WHEN regexp_matches(t, '^[^/]*/[0-9]+$') THEN t END AS cidr FROM t""",
)
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.expr(TOKENS).alias("token"))
    return op.build_rules(rows, "token")


OP = "CASE event_type WHEN 'view' THEN 'lookup' WHEN 'click' THEN 'reserve' ELSE 'fetch' END"


@query("p27_drain_gate", f"SELECT event_id, {OP} AS op FROM events WHERE {OP} <> 'reserve' OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 50 = 0)")
def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    drained = events.filter("event_type = 'error' AND event_id % 50 = 0").select("user_id")
    return op.drain_gate(events.select("event_id", "user_id", F.expr(OP).alias("op")), drained, "user_id", "op").select("event_id", "op")


@query("s32_audit_lines", f"""WITH {REQUEST_SQL} SELECT '{{"event_id":' || event_id || ',"kind":"' || kind || '","action":"' || action || '"}}' AS line FROM r""")
def s32(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "events").select("event_id", *[F.expr(v).alias(k) for k, v in REQUEST.items()])
    return op.audit_lines(r, ["event_id", "kind", "action"])


@query("s10_audit_overflow", f"WITH {REQUEST_SQL} SELECT kind, count(*) AS lines FROM r WHERE event_id % 100 >= 64 GROUP BY kind")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "events").select("event_id", F.expr(REQUEST["kind"]).alias("kind")).filter("event_id % 100 >= 64")
    return r.groupBy("kind").agg(F.count("*").alias("lines"))
