"""Bloom sketches as tables of set bits: (node, m, k, bit).

A key's bits are ``(h1 + i * h2) mod m`` for i below k. Building is a distinct, merging a union,
probing an equi-join on bits that counts k hits; no binary has to fit one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.hashing import hash52

DEFAULT_RATE = 0.01


def bloom_params(n: int, rate: float) -> tuple[int, int]:
    """(m, k) for n keys at a false-positive rate (A2): m in whole words of 64, k from the unrounded m."""
    n = max(1, n)
    rate = rate if 0 < rate < 1 else DEFAULT_RATE
    bits = -n * math.log(rate) / math.log(2) ** 2
    return -(-math.ceil(bits) // 64) * 64, max(1, round(bits / n * math.log(2)))


def bloom_params_columns(n: Column, rate: Column) -> tuple[Column, Column]:
    """bloom_params() of columns."""
    n = F.greatest(n, F.lit(1))
    rate = F.when((rate > 0) & (rate < 1), rate).otherwise(DEFAULT_RATE)
    bits = -n * F.log(rate) / F.lit(math.log(2) ** 2)
    m = F.ceil(F.ceil(bits) / 64) * 64
    return m.cast("bigint"), F.greatest(F.round(bits / n * F.lit(math.log(2))), F.lit(1)).cast("int")


def bits(key: Column, m: int, k: int) -> Column:
    """The k bit numbers of a key; a number may come twice."""
    h1, h2 = hash52(key, 0), hash52(key, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h1 + i * h2) % F.lit(m))


def build_sketch(keys: DataFrame, node: Column, key: Column, m: int, k: int) -> DataFrame:
    """(node, m, k, bit) of the keys of each node (A1)."""
    set_bits = keys.select(node.alias("node"), F.explode(bits(key, m, k)).alias("bit")).distinct()
    return set_bits.select("node", F.lit(m).alias("m"), F.lit(k).alias("k"), "bit")


def to_words(sketch: DataFrame) -> DataFrame:
    """(node, m, k, word, value): the sketch's 32-bit words, the compact form to store."""
    value = F.sum(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("value")
    return sketch.groupBy("node", "m", "k", F.expr("bit div 32").alias("word")).agg(value)


def valid_headers(headers: DataFrame) -> DataFrame:
    """Headers (node, m, k, n_bytes) that are usable and agree with the first node's parameters.

    A header takes 8 bytes, m and k must be positive, and the bytes must hold m bits.
    """
    usable = headers.filter((F.col("n_bytes") >= 8) & (F.col("m") > 0) & (F.col("k") > 0) & ((F.col("n_bytes") - 8) * 8 >= F.col("m")))
    pin = usable.agg(F.min_by(F.struct("m", "k"), "node").alias("pin"))
    return usable.crossJoin(F.broadcast(pin)).filter((F.col("m") == F.col("pin.m")) & (F.col("k") == F.col("pin.k"))).drop("pin")


def merge_sketches(sketches: DataFrame, m: int, k: int) -> DataFrame:
    """(m, k, bit) set in any node's sketch of these parameters."""
    return sketches.filter((F.col("m") == m) & (F.col("k") == k)).select("m", "k", "bit").distinct()


def merged_header(merged: DataFrame) -> DataFrame:
    """(m, k, n_bits) of a merged sketch; 1, 1 and 0 if it is empty (A3)."""
    one = merged.agg(F.max("m").alias("m"), F.max("k").alias("k"), F.count("*").alias("n_bits"))
    return one.select(F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("k", F.lit(1)).alias("k"), "n_bits")


def maybe_contains(probes: DataFrame, id_col: str, key: Column, merged: DataFrame, m: int, k: int) -> DataFrame:
    """(id, maybe) of each probe against one merged sketch; false if it is empty."""
    wanted = probes.select(id_col, F.explode(F.array_distinct(bits(key, m, k))).alias("bit"))
    marked = wanted.join(merged.select("bit", F.lit(1).alias("hit")), "bit", "left")
    return marked.groupBy(id_col).agg((F.count("hit") == F.count("*")).alias("maybe"))


def node_maybe_has(probes: DataFrame, id_col: str, node: Column, key: Column, sketch: DataFrame, m: int, k: int, unknown: bool) -> DataFrame:
    """(id, maybe) of each probe against its own node's sketch; ``unknown`` for nodes without one."""
    wanted = probes.select(id_col, node.alias("node"), F.explode(F.array_distinct(bits(key, m, k))).alias("bit"))
    marked = wanted.join(sketch.select("node", "bit", F.lit(1).alias("hit")), ["node", "bit"], "left")
    known = sketch.select("node").distinct().withColumn("known", F.lit(True))
    every = marked.join(known, "node", "left").groupBy(id_col)
    return every.agg(F.when(F.max("known"), F.count("hit") == F.count("*")).otherwise(F.lit(unknown)).alias("maybe"))


def windowed_sketch(events: DataFrame, ts: str, key: Column, m: int, k: int, every: str = "30 seconds") -> DataFrame:
    """(start, bit) of the keys of each tumbling window; runs on batch and streaming rows."""
    each = events.select(F.window(ts, every).alias("w"), F.explode(bits(key, m, k)).alias("bit"))
    return each.groupBy("w", "bit").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bit")
