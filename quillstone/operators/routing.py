"""Rendezvous routing, routing caches and staged routes.

A node set is small and its size is checked: it travels as an array literal in each row, so
scoring all nodes of a key needs neither a join nor a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.hashing import unit

MOST_NODES = 10_000
OVERLAP_WEIGHT = 0.2


def node_array(nodes: DataFrame, id_col: str, weight_col: str) -> Column:
    """The node set as an array literal of struct<node, weight>; refused beyond MOST_NODES."""
    rows = nodes.select(F.col(id_col).cast("string"), F.col(weight_col).cast("double")).limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"a node set of more than {MOST_NODES} nodes")
    items = [F.struct(F.lit(r[0]).alias("node"), F.lit(r[1]).alias("weight")) for r in sorted(rows)]
    return F.array(*items) if items else F.array().cast("array<struct<node:string,weight:double>>")


def scores(key: Column, nodes: Column, overlap=None) -> Column:
    """array<struct<score, node>>, best first, equal scores by node from the least.

    The score is the node's hash with the key in [0, 1), times its weight, times one plus
    OVERLAP_WEIGHT times ``overlap`` of the node. A weight of 0 scores 0.
    """

    def one(n: Column) -> Column:
        score = unit(F.concat_ws("|", n["node"], key)) * n["weight"]
        return F.struct(score * (1 + OVERLAP_WEIGHT * overlap(n["node"])) if overlap else score, n["node"])

    order = lambda a, b: (
        F.when(a["col1"] > b["col1"], -1).when(a["col1"] < b["col1"], 1).when(a["node"] < b["node"], -1).when(a["node"] > b["node"], 1).otherwise(0)
    )
    return F.transform(F.array_sort(F.transform(nodes, one), order), lambda s: F.struct(s["col1"].alias("score"), s["node"].alias("node")))


def hrw_primary(keys: DataFrame, key: Column, nodes: Column, overlap=None) -> DataFrame:
    """``keys`` with the node of highest score; null without nodes."""
    return keys.withColumn("node", F.get(scores(key, nodes, overlap), F.lit(0))["node"])


def hrw_top_k(keys: DataFrame, key: Column, nodes: Column, k: int, overlap=None) -> DataFrame:
    """``keys`` by their k best nodes: columns rank, from 1, and node (R2)."""
    best = F.slice(scores(key, nodes, overlap), 1, k)
    ranked = keys.select("*", F.posexplode(best).alias("at", "best"))
    return ranked.select(*keys.columns, (F.col("at") + 1).alias("rank"), F.col("best.node").alias("node"))


VIEW = "struct<id:string,state:string,weight:string>"


def routable_nodes(bodies: DataFrame, body_col: str) -> DataFrame:
    """(node, weight) of well-formed node bodies that may take traffic.

    Needs an id that isn't empty and a state without ``drain`` in any case; a weight that is no
    number or not positive is 1.
    """
    parsed = bodies.select(F.from_json(body_col, VIEW).alias("n")).filter(F.col("n.id").isNotNull() & (F.col("n.id") != ""))
    open_ = parsed.filter(~F.lower(F.coalesce("n.state", F.lit(""))).contains("drain"))
    weight = F.expr("try_cast(n.weight AS double)")
    return open_.select(F.col("n.id").alias("node"), F.when(weight > 0, weight).otherwise(1.0).alias("weight"))


def traffic_weight(state: Column) -> Column:
    """Share of traffic by membership state."""
    return F.when(state == "joining", 0.1).when(state == "active", 1.0).otherwise(0.0)


def drain_overlay(nodes: DataFrame, id_col: str, state_col: str, markers: DataFrame) -> DataFrame:
    """``nodes`` with state ``draining`` where a marker names them (J13). Markers have id_col."""
    marked = markers.select(id_col).distinct().withColumn("_marked", F.lit(True))
    state = F.when(F.col("_marked"), "draining").otherwise(F.col(state_col))
    return nodes.join(marked, id_col, "left").withColumn(state_col, state).drop("_marked")


def route_cache(lookups: DataFrame, puts: DataFrame, key_col: str, ts_col: str, ttl_seconds: int = 30) -> DataFrame:
    """``lookups`` with ``cached``: the node of the last put of the key at or before, if not expired.

    ``puts`` has key, ts and node. An entry expires ttl after its put and is valid at that very
    moment. One shuffle by key: both sides are merged in time order, puts first among equals.
    """
    rows = lookups.select("*", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_node"))
    sets = puts.select(key_col, ts_col, F.lit(0).alias("_kind"), F.col("node").cast("string").alias("_node"))
    order = Window.partitionBy(key_col).orderBy(ts_col, "_kind", "_node")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_kind") == 0, F.struct(F.col(ts_col).alias("at"), F.col("_node").alias("node"))), ignorenulls=True).over(upto)
    seen = rows.unionByName(sets, allowMissingColumns=True).withColumn("_last", last).filter("_kind = 1")
    valid = F.col("_last.at") + F.expr(f"INTERVAL {ttl_seconds} SECONDS") >= F.col(ts_col)
    return seen.withColumn("cached", F.when(valid, F.col("_last.node"))).drop("_kind", "_node", "_last")


def read_route(requests: DataFrame, maybe: Column, cached: Column, resolved: Column) -> DataFrame:
    """``requests`` with source and node: a negative sketch misses, then cache, then resolver."""
    source = F.when(~maybe, "bloom_miss").when(cached.isNotNull(), "cache").when(resolved.isNotNull(), "hrw").otherwise("miss")
    node = F.when(maybe, F.coalesce(cached, resolved))
    return requests.withColumn("source", source).withColumn("node", node)


def write_route(requests: DataFrame, cached: Column, resolved: Column) -> DataFrame:
    """``requests`` with source and node: cache, then resolver; the sketch isn't asked."""
    source = F.when(cached.isNotNull(), "cache").when(resolved.isNotNull(), "hrw").otherwise("miss")
    return requests.withColumn("source", source).withColumn("node", F.coalesce(cached, resolved))


def fan_out(local: DataFrame, ranked: DataFrame, peers: DataFrame, id_col: str) -> DataFrame:
    """(id, source, node) of lookups: the primary on a local hit, else the best-ranked peer that may have it.

    ``local`` has id and hit; ``ranked`` id, rank, node; ``peers`` id, node, maybe. The first
    peer that may have the key ends the probe; without one the lookup misses.
    """
    primary = ranked.filter("rank = 1").select(id_col, F.col("node").alias("primary"))
    asked = ranked.filter("rank > 1").join(peers.filter("maybe"), [id_col, "node"])
    best = asked.groupBy(id_col).agg(F.min_by("node", "rank").alias("peer"))
    every = local.join(primary, id_col, "left").join(best, id_col, "left")
    source = F.when(F.col("hit"), "primary").when(F.col("peer").isNotNull(), "peer").otherwise("miss")
    return every.select(id_col, source.alias("source"), F.when(F.col("hit"), F.col("primary")).otherwise(F.col("peer")).alias("node"))


def recency_rank(rows: DataFrame, group_cols: list[str], key_col: str, ts_col: str) -> DataFrame:
    """(groups, key, rank): keys by their last access, the most recent first, ties by key."""
    last = rows.groupBy(*group_cols, key_col).agg(F.max(ts_col).alias("last"))
    order = Window.partitionBy(*group_cols).orderBy(F.desc("last"), key_col)
    return last.withColumn("rank", F.row_number().over(order)).drop("last")


def capacity_limit(ranked: DataFrame, most: int) -> DataFrame:
    """The rows of rank up to ``most``."""
    return ranked.filter(F.col("rank") <= most)
