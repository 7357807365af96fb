"""Identity, access and boundary decisions as expressions and dimension joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the access matrix.
DATA_ACTIONS = ["lookup", "reserve", "publish", "fetch", "seal", "release"]
ADMIN_ACTIONS = ["admin_read", "admin_write", "cluster_admin"]
WRITE_ACTIONS = ["reserve", "publish", "seal"]


def rbac_decision(kind: Column, action: Column, own: Column, target: Column, deletion_pending: Column) -> Column:
    """``allow`` or ``deny`` (P13): the identity is known, its kind may do the action, a tenant
    stays within its own, and a pending deletion blocks writes."""
    may = F.when(action.isin(DATA_ACTIONS), kind.isin("tenant", "internal")).when(action.isin(ADMIN_ACTIONS), kind == "admin").otherwise(False)
    denied = kind.isNull() | (kind == "unknown") | ~may
    denied = denied | ((kind == "tenant") & ~own.eqNullSafe(target)) | (deletion_pending & action.isin(WRITE_ACTIONS))
    return F.when(denied, "deny").otherwise("allow")


def normal_host(host: Column) -> Column:
    """A host in lower case without one trailing dot."""
    return F.regexp_replace(F.lower(host), r"\.$", "")


def host_matches(host: Column, glob: Column) -> Column:
    """Whether a host is the glob, or lies strictly below it for ``*.domain``."""
    h, g = normal_host(host), normal_host(glob)
    tail = F.substring(g, 2, 1 << 30)
    below = F.endswith(h, tail) & (F.length(h) > F.length(tail))
    return F.coalesce((h != "") & (g != "") & F.when(F.startswith(g, F.lit("*")), below).otherwise(h == g), F.lit(False))


IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    octets = F.transform(F.split(ip, r"\."), lambda p: p.cast("bigint"))
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda all_, o: F.when(o <= 255, all_ * 256 + o))
    return F.when(ip.rlike(IPV4), value)


def ip_in_cidr(ip: Column, cidr: Column) -> Column:
    """Whether an IPv4 address lies in a network; false if either is malformed."""
    bits = F.regexp_extract(cidr, r"^[^/]*/(\d{1,2})$", 1)
    width = F.when(bits != "", bits).cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - width).cast("bigint")
    a, b = ip_number(ip), ip_number(F.substring_index(cidr, "/", 1))
    return F.coalesce((width <= 32) & (F.floor(a / size) == F.floor(b / size)), F.lit(False))


URL = r"^https?://([^/]+)"


def url_host(url: Column) -> Column:
    """struct<host, port> of an http or https URL; an empty host and port 0 if it can't be read."""
    authority = F.regexp_replace(F.regexp_extract(url, URL, 1), "^.*@", "")
    host, digits = F.substring_index(authority, ":", 1), F.regexp_extract(authority, r"^[^:]*:(\d{1,5})$", 1)
    given = F.when(digits != "", digits).cast("int")
    port = F.when(~authority.contains(":"), F.when(F.startswith(url, F.lit("https:")), 443).otherwise(80)).otherwise(given)
    good = F.coalesce((host != "") & port.between(1, 65535), F.lit(False))
    return F.struct(F.when(good, host).otherwise("").alias("host"), F.when(good, port).otherwise(0).alias("port"))


def build_rules(tokens: DataFrame, token_col: str) -> DataFrame:
    """(ordinal, host_glob, cidr): a token with digits alone after a slash is a network; empty ones are left out."""
    is_net = F.col(token_col).rlike(r"^[^/]*/\d+$")
    rows = tokens.filter(F.col(token_col) != "")
    return rows.select("ordinal", F.when(~is_net, F.col(token_col)).alias("host_glob"), F.when(is_net, F.col(token_col)).alias("cidr"))


def boundary_check(host: Column, purpose: Column, rules: list[tuple[str | None, str]], default_deny: bool = True) -> Column:
    """struct<allow, reason> of an endpoint (P17). A rule is (purpose or None for any, glob or network).

    An empty host is denied; else the first rule of its purpose that fits allows it. The rule
    set is policy, not data: it comes as a list and becomes one expression.
    """
    hits = []
    for wanted, rule in rules:
        net = "/" in rule and rule.partition("/")[2].isdigit()
        fits = ip_in_cidr(host, F.lit(rule)) if net else host_matches(host, F.lit(rule))
        hits.append(fits if wanted is None else fits & (purpose == wanted))
    hit = reduce(lambda a, b: a | b, hits, F.lit(False))
    reason = F.when(host == "", "empty host").when(hit | F.lit(not default_deny), "").otherwise("not allowed")
    return F.struct((reason == "").alias("allow"), reason.alias("reason"))


def regulated_mode(checks: DataFrame, config: list[str], ordinal: str) -> DataFrame:
    """(config, valid, reason): all checks of a configuration pass, else the first failure's reason.

    ``checks`` has config, ordinal, passed and reason.
    """
    failure = F.min(F.when(~F.col("passed"), F.struct(F.col(ordinal).alias("at"), F.col("reason").alias("reason"))))
    rows = checks.groupBy(*config).agg(failure.alias("f"))
    return rows.select(*config, F.col("f").isNull().alias("valid"), F.coalesce("f.reason", F.lit("")).alias("reason"))


SPIFFE = r"^spiffe://([^/]+)(/.*)?$"


def spiffe(uri: Column) -> Column:
    """struct<trust_domain, path> of a SPIFFE id; null if it is none, or has the path ``/`` alone."""
    domain, path = F.regexp_extract(uri, SPIFFE, 1), F.regexp_extract(uri, SPIFFE, 2)
    return F.when((domain != "") & (path != "/"), F.struct(domain.alias("trust_domain"), path.alias("path")))


def spiffe_tenant(uri: Column) -> Column:
    """The tenant named after ``/tenant/`` in a SPIFFE id, or null."""
    return F.nullif(F.regexp_extract(spiffe(uri)["path"], "/tenant/([^/]*)", 1), F.lit(""))


def workload(uri: Column, trust_domain: str = "") -> Column:
    """struct<kind, id> of an internal workload's SPIFFE id in the trust domain, or null (P20).

    Kinds are node, cp and kvagent; all but cp need an id.
    """
    parsed = spiffe(uri)
    kind, name = F.regexp_extract(parsed["path"], "^/([^/]+)", 1), F.regexp_extract(parsed["path"], "^/[^/]+/(.*)$", 1)
    good = kind.isin("node", "cp", "kvagent") & ((kind == "cp") | (name != ""))
    if trust_domain:
        good = good & (parsed["trust_domain"] == trust_domain)
    return F.when(good, F.struct(kind.alias("kind"), name.alias("id")))


def resolve_certificates(certs: DataFrame, by_spiffe: DataFrame, by_cn: DataFrame, trust_domain: str = "") -> DataFrame:
    """``certs`` (spiffe_id, cn) with ``identity``.

    A well-formed id of a foreign trust domain refuses, without a look at the common name; an
    unmapped or malformed one falls back to it.
    """
    ids = by_spiffe.select("spiffe_id", F.col("identity").alias("_by_id"))
    names = by_cn.select("cn", F.col("identity").alias("_by_cn"))
    parsed = spiffe(F.col("spiffe_id"))
    foreign = parsed.isNotNull() & (parsed["trust_domain"] != trust_domain) if trust_domain else F.lit(False)
    rows = certs.join(ids, "spiffe_id", "left").join(names, "cn", "left")
    mapped = F.when(parsed.isNotNull(), F.col("_by_id"))
    return rows.withColumn("identity", F.when(~F.coalesce(foreign, F.lit(False)), F.coalesce(mapped, "_by_cn"))).drop("_by_id", "_by_cn")


def resolve_tenants(certs: DataFrame) -> DataFrame:
    """``certs`` with ``tenant``: the identity's, else the SPIFFE path's, else the common name."""
    return certs.withColumn("tenant", F.coalesce(F.nullif("identity", F.lit("")), spiffe_tenant(F.col("spiffe_id")), F.nullif("cn", F.lit(""))))


QUANTITY = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+|[numkMGTPE]|[KMGTPE]i)?$"


def validate_tenants(tenants: DataFrame, clusters: DataFrame) -> DataFrame:
    """``tenants`` with ``reason`` of the first failure, empty if valid.

    Columns: tenant_id, capacity, qps, bandwidth, priority, cluster and identities, an array of
    struct<spiffe_id, cn, kind>. ``clusters`` has cluster.
    """
    known = clusters.select("cluster").distinct().withColumn("_known", F.lit(True))
    bad = lambda i: (
        ((i["spiffe_id"] == "") & (i["cn"] == ""))
        | ((i["spiffe_id"] != "") & ~F.startswith(i["spiffe_id"], F.lit("spiffe://")))
        | ~i["kind"].isin("", "tenant", "internal", "admin")
    )
    quota = F.col("capacity").rlike(QUANTITY) & F.col("bandwidth").rlike(QUANTITY) & (F.col("qps") > 0)
    reason = (
        F.when(~F.col("tenant_id").rlike("^[0-9a-fA-F]{32}$"), "InvalidTenantID")
        .when(~quota, "InvalidQuota")
        .when(~F.col("priority").isin("", "P0", "P1", "P2"), "InvalidPriority")
        .when(F.col("cluster") == "", "MissingClusterRef")
        .when(F.col("_known").isNull(), "ClusterNotFound")
        .when(F.exists("identities", bad), "InvalidIdentity")
        .otherwise("")
    )
    return tenants.join(known, "cluster", "left").withColumn("reason", reason).drop("_known")


def identity_entries(bodies: DataFrame, body_col: str) -> DataFrame:
    """(spiffe_id, cn, kind) of identity entries; each needs an id or a name, an unknown kind stays unknown."""
    parsed = bodies.select(F.from_json(body_col, "struct<spiffe_id:string,cn:string,kind:string>").alias("e"))
    rows = parsed.select(*[F.coalesce(f"e.{c}", F.lit("")).alias(c) for c in ("spiffe_id", "cn", "kind")])
    kind = F.when(F.col("kind").isin("tenant", "internal", "admin"), F.col("kind")).otherwise("unknown")
    return rows.filter("spiffe_id <> '' OR cn <> ''").withColumn("kind", kind)


def reconcile(desired: DataFrame, existing: DataFrame, key: str, value: str) -> DataFrame:
    """(key, action): put what is missing or differs, delete what isn't desired."""
    both = desired.select(key, F.col(value).alias("_want")).join(existing.select(key, F.col(value).alias("_have")), key, "full_outer")
    action = F.when(F.col("_want").isNull(), "delete").when(F.col("_have").isNull() | (F.col("_have") != F.col("_want")), "put")
    return both.select(key, action.alias("action")).filter("action IS NOT NULL")


def drain_gate(requests: DataFrame, drained: DataFrame, node: str, op_col: str) -> DataFrame:
    """``requests`` without new reserves on drained nodes."""
    marked = drained.select(node).distinct().withColumn("_drained", F.lit(True))
    return requests.join(marked, node, "left").filter((F.col(op_col) != "reserve") | F.col("_drained").isNull()).drop("_drained")


def denials(checked: DataFrame, labels: list[str]) -> DataFrame:
    """(labels, denied): what the deny observer counts."""
    return checked.filter("NOT allow").groupBy(*labels).agg(F.count("*").alias("denied"))


def audit_lines(records: DataFrame, columns: list[str]) -> DataFrame:
    """Audit records as JSON lines."""
    return records.select(F.to_json(F.struct(*columns)).alias("line"))


def aligned_decisions(requests: DataFrame, keys: list[str], ts_ms: str, order: list[str], ttl_ms: int = 1000) -> DataFrame:
    """``requests`` with ``hit``: a decision is made once for each key and clock-aligned time to live."""
    span = Window.partitionBy(*keys, F.expr(f"{ts_ms} div {int(ttl_ms)}")).orderBy(ts_ms, *order)
    return requests.withColumn("hit", F.row_number().over(span) > 1)
