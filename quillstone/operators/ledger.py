"""Append logs and the tables read from them: watermarks, replay, checkpoints, upserts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def reserve(requests: DataFrame, order: list[str], bytes_col: str, slots: int, slot_bytes: int, pool: list[str]) -> DataFrame:
    """``requests`` with ``status``: INVAL for no bytes, NOMEM over a slot or once the pool is empty, else OK.

    A pool is one node's slots; its requests are admitted in order.
    """
    fits = (F.col(bytes_col) > 0) & (F.col(bytes_col) <= slot_bytes)
    used = F.sum(F.when(fits, 1).otherwise(0)).over(running(pool, order))
    return requests.withColumn("status", F.when(F.col(bytes_col) <= 0, "INVAL").when(~fits | (used > slots), "NOMEM").otherwise("OK"))


def watermarks(pubs: DataFrame, handle: list[str], order: list[str], mark_col: str) -> DataFrame:
    """``pubs`` with ``watermark``: the highest mark published so far."""
    return pubs.withColumn("watermark", F.max(mark_col).over(running(handle, order)))


def stamp_epochs(events: DataFrame, node: list[str], order: list[str]) -> DataFrame:
    """``events`` with ``epoch``: 1, 2, .. in each node's order."""
    return events.withColumn("epoch", F.row_number().over(Window.partitionBy(*node).orderBy(*order)))


def latest(log: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """(keys, values) of each key's last row; combined before the shuffle."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return log.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def valid_prefix(log: DataFrame, stream: list[str], order: list[str], ok: Column) -> DataFrame:
    """The rows of each stream before its first bad one: what a replay of a torn log keeps."""
    bad = F.sum(F.when(ok, 0).otherwise(1)).over(running(stream, order))
    return log.withColumn("_bad", bad).filter("_bad = 0").drop("_bad")


def replay(log: DataFrame, keys: list[str], order: list[str], op_col: str, values: list[str]) -> DataFrame:
    """The state after a log of inserts and removes: the last insert of each key not removed later."""
    return latest(log, keys, order, [op_col, *values]).filter(~F.col(op_col).isin("REMOVE", "DELETE")).drop(op_col)


def checkpoint(log: DataFrame, keys: list[str], order_col: str, op_col: str, values: list[str], upto: int) -> tuple[DataFrame, DataFrame]:
    """(snapshot, rest): the state at ``upto`` and the log rows after it; replaying both gives the whole log's state."""
    old = log.filter(F.col(order_col) <= upto)
    snapshot = latest(old, keys, [order_col], [op_col, order_col, *values]).filter(~F.col(op_col).isin("REMOVE", "DELETE"))
    return snapshot, log.filter(F.col(order_col) > upto)


def table_checksum(rows: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """(groups, n, checksum): an order-free checksum of rows, to compare a snapshot with its reread.

    The total is that of all rows modulo 2**64, as a signed long, so no number of rows is too large.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns])
    part = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(28,0)")
    whole, half = (F.lit(Decimal(1 << b)) for b in (64, 63))
    rest = F.pmod(F.sum(part), whole)
    signed = F.when(rest >= half, rest - whole).otherwise(rest).cast("bigint")
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), signed.alias("checksum"))


def commit(handles: DataFrame, watermark_col: str, depth_col: str, store: Column) -> DataFrame:
    """``handles`` with ``status`` and ``staged`` bytes of a seal commit.

    No path or no watermark is INVAL; a policy that doesn't store is SKIPPED; else the bytes up
    to the watermark are staged.
    """
    status = F.when((F.col(depth_col) <= 0) | (F.col(watermark_col) <= 0), "INVAL").when(~store, "SKIPPED").otherwise("OK")
    rows = handles.withColumn("status", status)
    return rows.withColumn("staged", F.when(F.col("status") == "OK", F.col(watermark_col)).otherwise(0))


def state_get(keys: DataFrame, key: str, cache: DataFrame, log: DataFrame, order: list[str], value: str) -> DataFrame:
    """(key, value, source): from the cache, else from the log's last put, else NOT_FOUND."""
    logged = latest(log, [key], order, [value]).withColumnRenamed(value, "_logged")
    both = keys.join(cache.select(key, F.col(value).alias("_cached")), key, "left").join(logged, key, "left")
    source = F.when(F.col("_cached").isNotNull(), "cache").when(F.col("_logged").isNotNull(), "log").otherwise("NOT_FOUND")
    return both.select(key, F.coalesce("_cached", "_logged").alias(value), source.alias("source"))


def compare_and_put(table: DataFrame, puts: DataFrame, key: str) -> DataFrame:
    """``puts`` with ``applied``: the expected revision is the key's, 0 meaning that it has none."""
    now = table.select(key, F.col("revision").alias("_now"))
    return puts.join(now, key, "left").withColumn("applied", F.coalesce("_now", F.lit(0)) == F.col("expected")).drop("_now")


def references(ops: DataFrame, keys: list[str], order: list[str], delta: Column) -> DataFrame:
    """``ops`` with ``refcount``: holds less releases so far, from 1 for the owner."""
    return ops.withColumn("refcount", F.lit(1) + F.sum(delta).over(running(keys, order)))


def reclaimable(retired: DataFrame, readers: DataFrame, epoch_col: str, witness_col: str) -> DataFrame:
    """Retired rows that no reader can see: their epoch is at most the least one witnessed; all without readers."""
    floor = readers.agg(F.min(witness_col).alias("_floor"))
    return retired.crossJoin(F.broadcast(floor)).filter(F.col("_floor").isNull() | (F.col(epoch_col) <= F.col("_floor"))).drop("_floor")


def expired(reservations: DataFrame, ts_col: str, now: Column, ttl_seconds: int = 300) -> DataFrame:
    """Reservations whose slot a sweep frees: older than their time to live (T4)."""
    return reservations.filter(F.col(ts_col) + F.expr(f"INTERVAL {ttl_seconds} SECONDS") < now)


def after_cursor(events: DataFrame, stream: list[str], order: list[str], epoch_col: str) -> DataFrame:
    """Events whose epoch is above all before them in arrival order; epoch 0 never is."""
    before = F.max(epoch_col).over(Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col(epoch_col) > F.col("_before")).drop("_before")


def is_warm(event_type: Column, tier: Column, max_tier: int = 1) -> Column:
    """Whether an event adds to a tier from 1 to ``max_tier`` (P10)."""
    return (event_type == "ADD") & tier.between(1, max_tier)


def adopt_views(views: DataFrame, cluster: list[str], order: list[str]) -> DataFrame:
    """Cluster views that are taken over: a new leader's always, the same leader's if its epoch rises.

    Compared with the last view that was taken over of the same leadership.
    """
    series = Window.partitionBy(*cluster).orderBy(*order)
    fresh = F.coalesce((F.col("leader") != F.lag("leader").over(series)).cast("int"), F.lit(1))
    rows = views.withColumn("_fresh", fresh).withColumn("_term", F.sum("_fresh").over(series))
    term = Window.partitionBy(*cluster, "_term").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("epoch").over(term)
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("epoch") > F.col("_before"))).drop("_fresh", "_term", "_before")


