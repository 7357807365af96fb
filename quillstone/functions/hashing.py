"""Hash identities and byte packing as Column expressions.

The reference data model hashes with BLAKE3; only equality and uniformity of those hashes can be
observed, so ``md5`` and ``sha2`` stand in, which every SQL engine computes alike. FNV-1a has
fixed test vectors and is computed as it is defined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a, 64 bits: the offset basis and the prime, in 32-bit halves.
FNV_BASIS = (0xCBF29CE4, 0x84222325)
FNV_PRIME_LOW = 0x1B3  # the prime is 2**40 + 0x1b3
LOW32 = 0xFFFFFFFF

#: Bits of a hash that unit() and hash52() keep: 13 hexadecimal digits.
UNIT_BITS = 52


def fnv1a64(value: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes, or of a binary, as 16 hexadecimal digits (F1).

    The state is two 32-bit halves: times 2**40 + 0x1b3 modulo 2**64 stays within BIGINT.
    Null gives null; the empty string gives the basis.
    """
    digits = F.hex(value.cast("binary"))
    count = (F.length(digits) / 2).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))

    def step(state: Column, octet: Column) -> Column:
        low = state["low"].bitwiseXOR(octet)
        product = low * FNV_PRIME_LOW
        high = state["high"] * FNV_PRIME_LOW + F.shiftright(product, 32) + low * 256
        return F.struct(high.bitwiseAND(F.lit(LOW32)).alias("high"), product.bitwiseAND(F.lit(LOW32)).alias("low"))

    start = F.struct(F.lit(FNV_BASIS[0]).cast("bigint").alias("high"), F.lit(FNV_BASIS[1]).cast("bigint").alias("low"))
    pad = lambda half: F.lpad(F.lower(F.hex(half)), 8, "0")
    return F.when(value.isNotNull(), F.aggregate(octets, start, step, lambda s: F.concat(pad(s["high"]), pad(s["low"]))))


def identity_hash(*parts: Column) -> Column:
    """Stand-in for the 128-bit identity hash: md5 of the parts joined by ``|`` (F2)."""
    return F.md5(F.concat_ws("|", *parts))


def short_digest(value: Column, digits: int = 32) -> Column:
    """The first digits of SHA-1."""
    return F.substring(F.sha1(value), 1, digits)


def checksum(value: Column) -> Column:
    """CRC-32, IEEE."""
    return F.crc32(value)


def safe_key(value: Column, most: int = 80, digits: int = 8) -> Column:
    """A key of letters, digits, ``.``, ``_`` and ``-``, cut at ``most``, and a digest suffix."""
    clean = F.left(F.regexp_replace(value, "[^A-Za-z0-9._-]", "-"), F.lit(most))
    return F.concat_ws("-", clean, F.substring(F.sha2(value, 256), 1, digits))


def short_hex(value: Column, digits: int = 12) -> Column:
    """Hexadecimal digits, cut with an ellipsis if there are more than ``digits``."""
    text = F.lower(F.hex(value))
    return F.when(F.length(text) > digits, F.concat(F.left(text, F.lit(digits)), F.lit("…"))).otherwise(text)


def big_endian(value: Column) -> Column:
    """16 hexadecimal digits of a BIGINT's two's complement, most significant byte first."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def little_endian(value: Column) -> Column:
    """16 hexadecimal digits of a BIGINT's two's complement, least significant byte first."""
    digits = big_endian(value)
    return F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])


def from_little_endian(digits: Column) -> Column:
    """The non-negative BIGINT whose little-endian hexadecimal digits these are."""
    turned = F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])
    return F.conv(turned, 16, 10).cast("bigint")


def hash52(value: Column, part: int = 0) -> Column:
    """13 hexadecimal digits of md5 as a BIGINT; parts 0 and 1 don't overlap."""
    return F.conv(F.substring(F.md5(value), 13 * part + 1, 13), 16, 10).cast("bigint")


def unit(value: Column) -> Column:
    """A hash of the value spread over [0, 1)."""
    return hash52(value) / F.lit(float(1 << UNIT_BITS))
