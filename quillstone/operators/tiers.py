"""Storage tiers: lookups through them, retention policies, and what their operations show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tier numbers, and what each kind of state allows. A kind without a policy
# stores, may be evicted and is recomputed.
TIERS = {"hbm": 1, "pinned": 2, "dram": 3, "nvme": 4, "cold": 5}
POLICIES = {"KV": ("evict", "recompute"), "TOOL_RESULT": ("evict", "recompute"), "MEMORY": ("evict", "replay"), "EXEC_STATE": ("pinned", "replay")}


def tiered_fetch(keys: DataFrame, key: str, tiers: dict[str, DataFrame]) -> DataFrame:
    """``keys`` with tier and payload: from the first tier, in the given order, that has the key.

    Each tier has key and payload, one row for a key. A miss has tier ``miss`` and no payload.
    """
    rows = keys
    for name, tier in tiers.items():
        rows = rows.join(tier.select(key, F.col("payload").alias(f"_{name}")), key, "left")
    hit = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), F.lit(n)) for n in tiers], F.lit("miss"))
    return rows.withColumn("tier", hit).withColumn("payload", F.coalesce(*[f"_{n}" for n in tiers])).drop(*[f"_{n}" for n in tiers])


def promotions(fetched: DataFrame, key: str, target: str) -> DataFrame:
    """Rows to write to ``target`` after a fetch: what a lower tier gave."""
    rank = F.create_map(*[x for n, k in TIERS.items() for x in (F.lit(n), F.lit(k))])
    return fetched.filter(rank[F.col("tier")] > TIERS[target]).select(key, "payload", F.lit(target).alias("tier"))


def replica_fetch(locators: DataFrame, index: DataFrame, dram: DataFrame, key: str) -> DataFrame:
    """Locators that the index has and whose bytes are in DRAM; the queues aren't touched."""
    return locators.join(index, key).join(dram, key)


def segments(transfers: DataFrame, bytes_col: str, size: int = 256 * 1024) -> DataFrame:
    """``transfers`` by segment: columns segment, from 0, and segment_bytes; none of no bytes."""
    count = F.ceil(F.col(bytes_col) / size).cast("int")
    parts = transfers.filter(F.col(bytes_col) > 0).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("segment"))
    return parts.withColumn("segment_bytes", F.least(F.lit(size), F.col(bytes_col) - F.col("segment") * size))


def cold_path(key: Column) -> Column:
    """The path of a cold object: two digits, the rest, ``.kv``."""
    return F.concat(F.substring(key, 1, 2), F.lit("/"), F.substring(key, 3, 1 << 30), F.lit(".kv"))


def slab_status(puts: DataFrame, order: list[str], node: list[str], bytes_col: str, slot: int, slots: int) -> DataFrame:
    """``puts`` with ``status`` of slab storage: reject for nothing or over a slot, full, else ok."""
    fits = (F.col(bytes_col) > 0) & (F.col(bytes_col) <= slot)
    series = Window.partitionBy(*node).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(fits, 1).otherwise(0)).over(series)
    return puts.withColumn("status", F.when(~fits, "reject").when(used > slots, "full").otherwise("ok"))


def occupancy(ops: DataFrame, pool: list[str], order: list[str], slots: int) -> DataFrame:
    """``ops`` (+1 acquire, -1 release in ``delta``) with in_use and utilization; 0 without slots."""
    series = Window.partitionBy(*pool).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ops.withColumn("in_use", F.sum("delta").over(series))
    return rows.withColumn("utilization", F.col("in_use") / F.lit(float(slots)) if slots else F.lit(0.0))


def tier_usage(entries: DataFrame, tier_cols: list[str], bytes_col: str) -> DataFrame:
    """(tiers, entries, bytes) held."""
    return entries.groupBy(*tier_cols).agg(F.count("*").alias("entries"), F.sum(bytes_col).alias("bytes"))


def op_counters(ops: DataFrame, op_col: str, bytes_col: str, status_col: str) -> DataFrame:
    """(op, calls, bytes, misses, errors) of a tier's operations."""
    status = F.col(status_col)
    return ops.groupBy(op_col).agg(
        F.count("*").alias("calls"), F.sum(F.when(status == "ok", F.col(bytes_col)).otherwise(0)).alias("bytes"),
        F.count_if(status == "miss").alias("misses"), F.count_if(status == "error").alias("errors"),
    )


def should_store(kind: Column, idempotent: Column, fetch_ms: Column, recompute_ms: Column) -> Column:
    """Whether keeping state is worth it.

    A tool result that isn't idempotent is never stored; with unknown recompute cost (0) state
    is; else if fetching takes less than recomputing.
    """
    worth = (recompute_ms == 0) | (fetch_ms < recompute_ms)
    return F.when((kind == "TOOL_RESULT") & ~idempotent, False).otherwise(worth)


def _policy(kind: Column, part: int, default: str) -> Column:
    table = F.create_map(*[x for k, v in POLICIES.items() for x in (F.lit(k), F.lit(v[part]))])
    return F.coalesce(F.try_element_at(table, kind), F.lit(default))


def eviction(kind: Column) -> Column:
    """``evict`` or ``pinned`` by kind of state."""
    return _policy(kind, 0, "evict")


def on_miss(kind: Column) -> Column:
    """``recompute`` or ``replay`` by kind of state."""
    return _policy(kind, 1, "recompute")


def eviction_victims(entries: DataFrame, node: list[str], age: list[str], bytes_col: str, kind_col: str, need: Column) -> DataFrame:
    """Entries to evict on each node so that ``need`` bytes come free: the oldest evictable ones."""
    usable = entries.filter(eviction(F.col(kind_col)) != "pinned")
    series = Window.partitionBy(*node).orderBy(*age).rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum(bytes_col).over(series), F.lit(0))
    return usable.withColumn("_freed", freed).filter(F.col("_freed") < need).drop("_freed")


def queue_places(ops: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``ops`` with ``where`` before each operation: miss, first or main.

    A key is in the first-time queue after one insert since it was last erased, and in the main
    one after more; what a cache of some size would have dropped is left to ``reuse``.
    """
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lives = ops.withColumn("_life", F.coalesce(F.count_if(F.col("op") == "erase").over(before), F.lit(0)))
    own = Window.partitionBy(*key, "_life").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.count_if(F.col("op") == "insert").over(own), F.lit(0))
    return lives.withColumn("where", F.when(held == 0, "miss").when(held == 1, "first").otherwise("main")).drop("_life")


def reuse(accesses: DataFrame, key: list[str], order: list[str], ts_us: str) -> DataFrame:
    """``accesses`` with ``gap_us`` since the key's last one, null at its first: what a retention time would hold."""
    series = Window.partitionBy(*key).orderBy(*order)
    return accesses.withColumn("gap_us", F.col(ts_us) - F.lag(ts_us).over(series))


def deferred_evictions(ops: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, outcome) of evictions (T2): pruned, deferred, or dropped.

    ``ops`` has key, order and op: insert, acquire, release or evict. An eviction prunes a leaf
    that nobody but its owner holds, and is deferred else; a deferred one prunes at the release
    that leaves the owner alone, and is dropped if the leaf is replaced before.
    """
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    lives = ops.withColumn("_life", F.count_if(F.col("op") == "insert").over(upto)).filter("_life > 0")
    own = Window.partitionBy(key, "_life").orderBy(order)
    sofar, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    move = F.when(F.col("op") == "acquire", 1).when(F.col("op") == "release", -1).otherwise(0)
    rows = lives.withColumn("_sum", F.sum(move).over(sofar))
    rows = rows.withColumn("_held", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(sofar)))  # by others than the owner
    rows = rows.withColumn("_waiting", F.coalesce(F.max(F.col("op") == "evict").over(before), F.lit(False)))
    ends = (F.col("_held") == 0) & ((F.col("op") == "evict") | ((F.col("op") == "release") & F.col("_waiting")))
    rows = rows.withColumn("_ends", ends).withColumn("_gone", F.coalesce(F.max("_ends").over(before), F.lit(False)))
    replaced = (F.lead("op").over(Window.partitionBy(key).orderBy(order)) == "insert") & (F.col("_waiting") | (F.col("op") == "evict")) & ~F.col("_ends") & ~F.col("_gone")
    rows = rows.withColumn("_next", F.when(replaced, F.lead(order).over(Window.partitionBy(key).orderBy(order))))
    own_row = F.when(~F.col("_gone") & F.col("_ends"), "pruned").when(~F.col("_gone") & (F.col("op") == "evict"), "deferred")
    both = F.array(F.struct(F.col(order).alias(order), own_row.alias("outcome")), F.struct(F.col("_next").alias(order), F.when(F.col("_next").isNotNull(), "dropped").alias("outcome")))
    return rows.select(key, F.inline(both)).filter("outcome IS NOT NULL")
