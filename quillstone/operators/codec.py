"""Tensor codec: deltas along the token axis, scales, quantization, and bytes.

A tensor is rows of (group, t, e, v): a group's tokens t and channels e. Open-loop steps are
windows and aggregates over such rows. The closed loop, where each delta is taken from what the
decoder will have, is a fold along tokens that needs one number of state for each channel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.fold import ordered_fold

#: Largest quantized value by bits.
LIMITS = {8: 127, 4: 7}


def channels(tensors: DataFrame, group: str, t: str, vector: str) -> DataFrame:
    """(group, t, e, v) rows of a table of vectors."""
    return tensors.select(F.col(group).alias("g"), F.col(t).alias("t"), F.posexplode(vector).alias("e", "v")).select("g", "t", "e", F.col("v").cast("double").alias("v"))


def token_delta(rows: DataFrame) -> DataFrame:
    """``rows`` with ``d``: the first difference along tokens, from 0."""
    series = Window.partitionBy("g", "e").orderBy("t")
    return rows.withColumn("d", F.col("v") - F.lag("v", 1, 0.0).over(series))


def channel_scales(rows: DataFrame, bits: int = 8) -> DataFrame:
    """(g, e, peak, scale): the largest absolute delta of each channel, and the step that covers it."""
    peak = token_delta(rows).groupBy("g", "e").agg(F.max(F.abs("d")).alias("peak"))
    return peak.withColumn("scale", F.col("peak") / F.lit(float(LIMITS[bits])))


def token_scales(rows: DataFrame, bits: int = 8) -> DataFrame:
    """(g, t, peak, scale): the largest absolute delta of each token over its channels (A15, open loop)."""
    peak = token_delta(rows).groupBy("g", "t").agg(F.max(F.abs("d")).alias("peak"))
    return peak.withColumn("scale", F.col("peak") / F.lit(float(LIMITS[bits])))


def quantize(value: Column, scale: Column, bits: int = 8) -> Column:
    """A value in steps of ``scale``: rounded half away from zero and clamped; 0 where the scale is."""
    x = value / F.when(scale != 0, scale)
    rounded = F.signum(x) * F.floor(F.abs(x) + 0.5)
    top = float(LIMITS[bits])
    return F.coalesce(F.greatest(F.lit(-top), F.least(F.lit(top), rounded)), F.lit(0.0)).cast("int")


def encode_open(rows: DataFrame, bits: int = 8) -> DataFrame:
    """(g, t, e, q, scale): quantized deltas by channel scale, each from its true predecessor."""
    return token_delta(rows).join(channel_scales(rows, bits), ["g", "e"]).select("g", "t", "e", quantize(F.col("d"), F.col("scale"), bits).alias("q"), "scale")


def decode(coded: DataFrame) -> DataFrame:
    """(g, t, e, v): running sums of q * scale along tokens."""
    series = Window.partitionBy("g", "e").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return coded.select("g", "t", "e", F.sum(F.col("q") * F.col("scale")).over(series).alias("v"))


def encode_closed(rows: DataFrame, bits: int = 8) -> DataFrame:
    """(g, t, e, q, scale): as encode_open, but each delta is from the decoder's last value.

    A channel's fold holds one number; channels are independent.
    """
    top = LIMITS[bits]

    def step(state: dict, r: dict) -> Iterator[tuple]:
        scale = r["scale"]
        x = (r["v"] - state["last"]) / scale if scale else 0.0
        q = int(max(-top, min(top, (1 if x >= 0 else -1) * int(abs(x) + 0.5))))
        state["last"] += q * scale
        yield r["g"], r["t"], r["e"], q, scale

    scaled = rows.join(channel_scales(rows, bits).select("g", "e", "scale"), ["g", "e"]).select("g", "t", "e", "v", "scale")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered_fold(scaled, ["g", "e"], ["t"], lambda: {"last": 0.0}, step, f"g {kind['g']}, t {kind['t']}, e int, q int, scale double")


def codec_error(rows: DataFrame, decoded: DataFrame) -> DataFrame:
    """(g, max_error, range, relative_rms) of a decoded tensor."""
    both = rows.join(decoded.withColumnRenamed("v", "w"), ["g", "t", "e"])
    off = F.col("v") - F.col("w")
    rms = F.sqrt(F.sum(off * off) / F.when(F.sum(F.col("v") * F.col("v")) > 0, F.sum(F.col("v") * F.col("v"))))
    return both.groupBy("g").agg(F.max(F.abs(off)).alias("max_error"), (F.max("v") - F.min("v")).alias("range"), F.coalesce(rms, F.lit(0.0)).alias("relative_rms"))


def pack_nibbles(low: Column, high: Column) -> Column:
    """Two values of -8 to 7 in one byte."""
    return low.bitwiseAND(F.lit(15)) + F.shiftleft(high.bitwiseAND(F.lit(15)), 4)


def unpack_nibbles(byte: Column) -> list[Column]:
    """The low and the high value of a byte, with their signs."""
    sign = lambda n: F.when(n > 7, n - 16).otherwise(n)
    return [sign(byte.bitwiseAND(F.lit(15))), sign(F.shiftright(byte, 4).bitwiseAND(F.lit(15)))]


def pack_tensor(coded: DataFrame) -> DataFrame:
    """(g, blob): a header of magic and shape, then tokens' quantized channels, as text fields."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "q"))), lambda x: x["q"].cast("string")), ",")
    tokens = coded.groupBy("g", "t").agg(line.alias("line"), F.count("*").alias("n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "line"))), lambda x: x["line"]), ";")
    return tokens.groupBy("g").agg(body.alias("body"), F.count("*").alias("t"), F.max("n").alias("e")).select(
        "g", F.concat_ws("|", F.lit("KVT1"), F.col("t").cast("string"), F.col("e").cast("string"), "body").alias("blob")
    )


@F.arrow_udf(T.BinaryType())
def _deflated(values: pa.Array) -> pa.Array:
    return pa.array([zlib.compress(v.as_py(), 6) if v.is_valid else None for v in values], pa.binary())


@F.arrow_udf(T.BinaryType())
def _inflated(values: pa.Array) -> pa.Array:
    return pa.array([zlib.decompress(v.as_py()) if v.is_valid else None for v in values], pa.binary())


def compress(blob: Column) -> Column:
    """struct<codec, size, data> of a blob, deflated where that is shorter."""
    data = _deflated(blob.cast("binary"))
    row = F.struct(F.octet_length(blob).alias("size"), data.alias("data"))
    return row


def decompress(stored: Column) -> Column:
    """The blob of what compress() gave."""
    return _inflated(stored["data"])


def encrypt(blob: Column, key: Column) -> Column:
    """AES-GCM with a random 12-byte nonce in front and a 16-byte tag behind."""
    return F.aes_encrypt(blob, key, F.lit("GCM"))


def decrypt(data: Column, key: Column) -> Column:
    """The plain bytes; null if the key or the tag is wrong."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"))


def layer_slice(blob: Column, layer: Column, layers: int) -> Column:
    """A layer's share of a blob: its length divided by the layers, the rest left out."""
    width = F.floor(F.length(blob) / layers).cast("int")
    return F.substring(blob, layer * width + 1, width)
