"""Locators, state identities and their keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.hashing import fnv1a64, identity_hash, little_endian

# Fixed values of the data model: kinds of state, and versions.
STATE_KINDS = {"KV": 0, "SANDBOX": 1, "EMBEDDING": 2, "TOOL_RESULT": 3, "MEMORY": 16, "EXEC_STATE": 17}
LOCATOR_VERSION = 1
IDENTITY_VERSION = 2
IDEMPOTENT = 1


def name_hash(name: Column) -> Column:
    """Hash of a tenant's or model's name; an empty tenant is 16 zeros."""
    return F.when(name == "", F.lit("0" * 16)).otherwise(fnv1a64(name))


def locator(tenant: Column, model: Column, prefix: Column, token_start: Column, token_count: Column) -> Column:
    """struct of a locator's parts."""
    where = F.struct(token_start.cast("bigint").alias("token_start"), token_count.cast("bigint").alias("token_count"))
    return F.struct(
        tenant.alias("tenant"), model.alias("model"), prefix.alias("prefix"), where.alias("range"),
        F.lit(LOCATOR_VERSION).alias("version"), F.lit(0).alias("flags"),
    )


def same_identity(a: Column, b: Column) -> Column:
    """Whether two locators name the same state; their ranges don't matter."""
    return (a["tenant"] == b["tenant"]) & (a["model"] == b["model"]) & (a["prefix"] == b["prefix"])


def identity_key(loc: Column) -> Column:
    """What same_identity compares, as one struct to group by."""
    return F.struct(loc["tenant"], loc["model"], loc["prefix"])


def locator_hash(loc: Column) -> Column:
    """Hash of what same_identity compares."""
    return identity_hash(loc["tenant"], loc["model"], loc["prefix"])


def encode_locator(loc: Column) -> Column:
    """A locator as text fields of fixed width: numbers little-endian, names hashed."""
    numbers = [loc["range"]["token_start"], loc["range"]["token_count"], loc["version"].cast("bigint")]
    return F.concat(name_hash(loc["tenant"]), name_hash(loc["model"]), F.rpad(loc["prefix"], 32, "0"), *map(little_endian, numbers))


def decode_version(code: Column) -> Column:
    """The version of an encoded locator, or null if it isn't the one that is understood."""
    version = F.conv(F.substring(code, 97, 2), 16, 10).cast("int")
    return F.when(version == LOCATOR_VERSION, version)


def state_identity(loc: Column) -> Column:
    """struct of the state identity of a locator: key-value state of its content."""
    return F.struct(
        F.lit(IDENTITY_VERSION).alias("version"), F.lit("KV").alias("state_kind"), F.lit(0).alias("flags"),
        name_hash(loc["tenant"]).alias("tenant"), locator_hash(loc).alias("content_hash"),
    )


def tool_identity(tenant: Column, tool: Column, args: Column, idempotent: Column) -> Column:
    """struct of a tool result's identity: the tool's and the arguments' hashes; flag bit 0 if idempotent."""
    return F.struct(
        F.lit(IDENTITY_VERSION).alias("version"), F.lit("TOOL_RESULT").alias("state_kind"),
        F.when(idempotent, IDEMPOTENT).otherwise(0).alias("flags"),
        name_hash(tenant).alias("tenant"), F.concat(fnv1a64(tool), fnv1a64(args)).alias("content_hash"),
    )


def folded_key(tenant: Column, prefix: Column, model: Column) -> Column:
    """16-digit cache key: the exclusive or of tenant, prefix and model hashes of 16 digits."""
    half = lambda c, k: F.conv(F.substring(c, 8 * k + 1, 8), 16, 10).cast("bigint")
    mixed = [half(tenant, k).bitwiseXOR(half(prefix, k)).bitwiseXOR(half(model, k)) for k in (0, 1)]
    return F.concat(*[F.lpad(F.lower(F.hex(m)), 8, "0") for m in mixed])


def content_key(content_hash: Column) -> Column:
    """Cache key of other state: the first 16 bytes of its content hash; the tenant is no part."""
    return F.substring(content_hash, 1, 32)
