"""Quotas, priorities and fairness."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.fold import Fold

INFLATION = 1.5
#: Arrival numbers of a range that is put in order by itself.
RANGE = 1 << 16


def inflated(limit: Column, inflate: Column) -> Column:
    """A limit, times 1.5 and truncated for tenants that may overcommit."""
    return F.when(inflate, F.floor(limit * INFLATION)).otherwise(limit).cast("bigint")


def reservations(total: Column, shares: list[Column]) -> list[Column]:
    """Integer split of a window by percentages; their sum of 0 counts as 100."""
    every = sum(shares[1:], shares[0])
    whole = F.when(every == 0, 100).otherwise(every)
    return [F.floor(total * s / whole).cast("bigint") for s in shares]


class Quota:
    """One tenant's counters; the rate window starts with the first request after it ran out."""

    def __init__(self) -> None:
        self.used, self.start, self.requests, self.bandwidth = 0, None, 0, 0

    def admit(self, r: dict, window_ms: int) -> str:
        if r["capacity"] is None:
            return "unknown_tenant"
        scale = INFLATION if r["inflated"] else 1.0
        capacity, qps, rate = (int(r[k] * scale) for k in ("capacity", "qps", "bps"))
        if (self.used + r["bytes"] > capacity) if capacity > 0 else r["bytes"] > 0:
            return "capacity"
        if self.start is None or r["ts_ms"] - self.start >= window_ms:
            self.start, self.requests, self.bandwidth = r["ts_ms"], 0, 0
        if qps > 0 and self.requests + r["requests"] > qps:
            return "qps"
        if rate > 0 and self.bandwidth + r["bandwidth"] > rate:
            return "bandwidth"
        self.used += r["bytes"] if capacity > 0 else 0
        self.requests += r["requests"]
        self.bandwidth += r["bandwidth"]
        return "ok"

    def release(self, size: int) -> None:
        self.used -= min(size, self.used)


ADMIT_FIELDS = ["tenant", "seq", "ts_ms", "bytes", "requests", "bandwidth", "released", "capacity", "qps", "bps", "inflated"]


def admit_fold(kind: str, window_ms: int = 1000) -> Fold:
    """Quota admission as a fold over rows of ADMIT_FIELDS."""

    def step(quota: Quota, r: dict) -> Iterator[tuple]:
        if r["released"]:
            quota.release(r["released"])
            result = "released"
        else:
            result = quota.admit(r, window_ms)
        yield r["tenant"], r["seq"], result, quota.used

    return Fold(["tenant"], ["seq"], Quota, step, f"tenant {kind}, seq bigint, result string, used bigint")


def admit(requests: DataFrame, limits: DataFrame, window_ms: int = 1000) -> DataFrame:
    """(tenant, seq, result, used) of each request in order.

    ``requests`` has tenant, seq, ts_ms, bytes, requests, bandwidth and released, where released
    over 0 gives back that many bytes instead of asking. ``limits`` has tenant, capacity, qps,
    bps and inflated. Capacity 0 denies any bytes; qps and bps 0 are no limits; denials don't
    count, and a later denial gives the capacity back.
    """
    rows = requests.join(limits, "tenant", "left").select(*ADMIT_FIELDS)
    return admit_fold(requests.schema["tenant"].dataType.simpleString(), window_ms).over(rows)


def aligned_admission(requests: DataFrame, qps: int, order: list[str]) -> DataFrame:
    """``requests`` with ``admitted`` by clock-aligned one-second windows: the closed form of the rate limit."""
    second = Window.partitionBy("tenant", F.expr("ts_ms div 1000")).orderBy(*order)
    return requests.withColumn("admitted", F.row_number().over(second) <= qps)


def capacity_used(moves: DataFrame, tenant: str, order: list[str], delta_col: str) -> DataFrame:
    """``moves`` with ``used``: reserved less released, never below 0.

    The floored sum is the running sum less its lowest value so far, where that is below 0.
    """
    series = Window.partitionBy(tenant).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = moves.withColumn("_sum", F.sum(delta_col).over(series))
    return rows.withColumn("used", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(series))).drop("_sum")


def round_robin(work: DataFrame, scope: list[str], class_col: str, tenant_col: str, seq_col: str) -> DataFrame:
    """``work`` with ``position``: by class, then in turns of tenants, who come in order of arrival.

    This is the dispatch order where all work is there from the start and may be admitted. Scope,
    class and the whole number ``seq_col``, unique, must not be null.
    """
    own = Window.partitionBy(*scope, class_col, tenant_col)
    rows = work.withColumn("_turn", F.row_number().over(own.orderBy(seq_col))).withColumn("_first", F.min(seq_col).over(own))
    # few scopes may hold all work: only the sizes of ranges of arrival are put in order, and each range by itself
    rows = rows.withColumn("_range", F.expr(f"_first div {RANGE}"))
    cell = [*scope, class_col, "_turn", "_range"]
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*scope).orderBy(class_col, "_turn", "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*cell).orderBy("_first"))
    placed = rows.withColumn("_within", within).join(starts, cell)
    return placed.withColumn("position", F.col("_start") + F.col("_within")).select(*work.columns, "position")


def class_stats(work: DataFrame, class_col: str, tenant_col: str, bytes_col: str) -> DataFrame:
    """(class, depth, bytes, tenants) of waiting work."""
    return work.groupBy(class_col).agg(F.count("*").alias("depth"), F.sum(bytes_col).alias("bytes"), F.countDistinct(tenant_col).alias("tenants"))


def class_load(work: DataFrame, scope: list[str], bucket: str, bytes_col: str, done_col: str) -> DataFrame:
    """(scope, bucket, submitted, finished, in_flight) in bytes, in_flight at the bucket's end.

    Work is summed by scope and time bucket before anything is ordered, so a busy class costs
    one row a bucket. In-flight bytes never fall below 0.
    """
    sums = work.groupBy(*scope, bucket).agg(
        F.sum(F.when(F.col(done_col), 0).otherwise(F.col(bytes_col))).alias("submitted"), F.sum(F.when(F.col(done_col), F.col(bytes_col)).otherwise(0)).alias("finished")
    )
    moves = sums.withColumn("_delta", F.col("submitted") - F.col("finished"))
    series = Window.partitionBy(*scope).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    rows = moves.withColumn("_sum", F.sum("_delta").over(series))
    return rows.withColumn("in_flight", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(series))).drop("_delta", "_sum")


def backlog(arrivals: DataFrame, subscriber: str, order: list[str], capacity: int) -> DataFrame:
    """``arrivals`` with ``depth`` and ``over``: what waits unread, and whether a ring of ``capacity`` would have dropped.

    ``drained`` is the number that the reader took before the arrival. The depth is that of an
    unbounded queue: the running sum less its lowest value, where a reader found it empty.
    """
    series = Window.partitionBy(subscriber).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = arrivals.withColumn("_sum", F.sum(1 - F.col("drained")).over(series))
    empty = F.min(F.col("_sum") - 1).over(series)
    return rows.withColumn("depth", F.col("_sum") - F.least(F.lit(0), empty)).drop("_sum").withColumn("over", F.col("depth") > capacity)
