"""Cluster membership: state machine, bursts, views and leases."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.fold import Fold

# The legal transitions; each node starts as joining.
LEGAL = {
    "joining": ("active", "unreachable"),
    "active": ("draining", "unreachable"),
    "draining": ("unreachable", "terminated"),
    "unreachable": ("joining", "terminated"),
    "terminated": (),
}


def is_legal(before: Column, after: Column) -> Column:
    """Whether a state may follow another."""
    pairs = [f"{a}>{b}" for a, following in LEGAL.items() for b in following]
    return F.concat_ws(">", before, after).isin(pairs)


def membership_fold(node: str, kind: str, seq: str, target: str) -> Fold:
    """The state machine as a fold over rows of node, seq and target."""

    def step(now: dict, r: dict) -> Iterator[tuple]:
        if r[target] == now["state"]:
            result = "same"
        elif r[target] in LEGAL.get(now["state"], ()):
            result, now["state"] = "ok", r[target]
        else:
            result = "illegal"
        yield r[node], r[seq], now["state"], result

    return Fold([node], [seq], lambda: {"state": "joining"}, step, f"{node} {kind}, {seq} bigint, state string, result string")


def membership(events: DataFrame, node: str, seq: str, target: str) -> DataFrame:
    """(node, seq, state, result) after each requested transition: ok, same or illegal."""
    kind = events.schema[node].dataType.simpleString()
    return membership_fold(node, kind, seq, target).over(events.select(node, seq, target))


def in_warmup(state: Column, joined_at: Column, now: Column, seconds: int) -> Column:
    """Whether a node still warms up."""
    return (state == "joining") & (now < joined_at + F.expr(f"INTERVAL {seconds} SECONDS"))


def bursts(changes: DataFrame, key: list[str], ts: str, gap: str) -> DataFrame:
    """(key, start, end, changes): changes closer than ``gap`` are published once (W9); batch or streaming."""
    return changes.groupBy(*key, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("changes")).select(
        *key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes"
    )


def leases(beats: DataFrame, node: str, ts: str, now: Column, ttl_seconds: int) -> DataFrame:
    """(node, last, alive) by the last heartbeat."""
    last = beats.groupBy(node).agg(F.max(ts).alias("last"))
    return last.withColumn("alive", F.col("last") + F.expr(f"INTERVAL {ttl_seconds} SECONDS") >= now)


def directory_source(events: DataFrame, cluster: str, order: list[str]) -> DataFrame:
    """Per-node events that count: those that come while no cluster view is live.

    ``events`` has kind: view, view_delete or node. A view is live until it is deleted.
    """
    series = Window.partitionBy(cluster).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    live = F.last(F.when(F.col("kind") == "view", True).when(F.col("kind") == "view_delete", False), ignorenulls=True).over(series)
    return events.withColumn("_live", F.coalesce(live, F.lit(False))).filter((F.col("kind") == "node") & ~F.col("_live")).drop("_live")


def publish_view(nodes: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, nodes): each cluster's view as one row of its nodes by id."""
    grouped = nodes.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("id", "state"))).alias("nodes"))
    return grouped.select(cluster, F.size("nodes").alias("n"), "nodes")


def lifecycle(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, state, starts): the last state of each request; a restart under the same key begins anew."""
    starts = F.count_if(F.col("op") == "start").alias("starts")
    last = F.max_by("op", F.struct(*order)).alias("op")
    rows = events.groupBy(key).agg(last, starts)
    state = F.when(F.col("starts") == 0, "unknown").when(F.col("op") == "start", "running").when(F.col("op") == "finish", "finished").when(F.col("op") == "pop", "taken").otherwise("cancelled")
    return rows.select(key, state.alias("state"), "starts")


def concat_layers(parts: DataFrame, request: str, layer: str, order: list[str], blob: str) -> DataFrame:
    """(request, layers, joined): each layer's last write, empty ones left out, by layer."""
    last = parts.groupBy(request, layer).agg(F.max_by(blob, F.struct(*order)).alias("_b")).filter("_b <> ''")
    every = last.groupBy(request).agg(F.array_sort(F.collect_list(F.struct(layer, "_b"))).alias("_l"))
    return every.select(request, F.size("_l").alias("layers"), F.array_join(F.transform("_l", lambda x: x["_b"]), "").alias("joined"))


def layer_order(registered: DataFrame, present: DataFrame, layer: str) -> DataFrame:
    """(layer, position): registered layers that are present, in their order, then the others by name."""
    both = present.select(layer).distinct().join(registered.select(layer, "ordinal"), layer, "left")
    order = Window.orderBy(F.col("ordinal").asc_nulls_last(), layer)
    return both.withColumn("position", F.row_number().over(order)).drop("ordinal")
