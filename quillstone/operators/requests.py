"""What engines' connectors and contexts do over time, as joins and windows over their logged steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def request_lifecycle(requests: DataFrame, matches: DataFrame, layers: DataFrame, releases: DataFrame, n_layers: int, token_bytes: int) -> DataFrame:
    """(id, extra, load_bytes, loaded, saved_bytes, saved) of each request that isn't released.

    ``requests`` has id, computed (tokens the engine has itself) and asked_bytes, the room for a
    load; ``matches`` has id and matched_tokens; ``layers`` a row for each layer saved: id, layer,
    bytes and n, of which the last counts; ``releases`` has id. A request loads what matched if
    anything did and there is room for it, is credited with the tokens beyond its own, and is
    saved once all its layers are there.
    """
    last = layers.groupBy("id", "layer").agg(F.max_by("bytes", "n").alias("bytes"))
    kept = last.groupBy("id").agg(F.sum("bytes").alias("saved_bytes"), (F.count("*") == n_layers).alias("saved"))
    rows = requests.join(releases.select("id").distinct(), "id", "left_anti").join(matches.select("id", "matched_tokens"), "id", "left").join(kept, "id", "left")
    matched = F.coalesce("matched_tokens", F.lit(0))
    size = matched * token_bytes
    loaded = (matched > 0) & (F.col("asked_bytes") >= size)
    return rows.select(
        "id", F.greatest(matched - F.col("computed"), F.lit(0)).cast("bigint").alias("extra"), F.when(loaded, size).otherwise(0).cast("bigint").alias("load_bytes"),
        loaded.alias("loaded"), F.coalesce("saved_bytes", F.lit(0)).cast("bigint").alias("saved_bytes"), F.coalesce("saved", F.lit(False)).alias("saved"),
    )


def context_protocol(steps: DataFrame, handle: str, seq: str) -> DataFrame:
    """``steps`` with ``status`` (E11): ok, or why a step of a handle's life is refused.

    ``steps`` has handle, seq, op (reserve, publish, seal, fetch or release) and watermark. A
    handle is reserved once, its watermark never falls, a seal needs something published and ends
    the writing, only what is sealed can be fetched, and a release ends the life.
    """
    before = Window.partitionBy(handle).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    lives = steps.withColumn("_life", F.coalesce(F.count_if(F.col("op") == "release").over(before), F.lit(0)))
    own = Window.partitionBy(handle, "_life").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.max(c).over(own), F.lit(False))
    op = F.col("op")
    rows = lives.withColumn("_reserved", seen(op == "reserve"))
    rows = rows.withColumn("_writes", (op == "publish") & F.col("_reserved")).withColumn("_written", seen(F.col("_writes")))
    rows = rows.withColumn("_sealed", seen((op == "seal") & F.col("_reserved") & F.col("_written")))
    rows = rows.withColumn("_mark", F.max(F.when(F.col("_writes") & ~F.col("_sealed"), F.col("watermark"))).over(own))
    status = (
        F.when(op == "reserve", F.when(F.col("_reserved"), "busy").otherwise("ok"))
        .when(op == "fetch", F.when(F.col("_sealed"), "ok").otherwise("not_found"))
        .when(~F.col("_reserved"), "unknown")
        .when(op == "release", "ok")
        .when(F.col("_sealed"), "sealed")
        .when(op == "seal", F.when(F.col("_written"), "ok").otherwise("empty"))
        .otherwise(F.when(F.col("watermark") < F.col("_mark"), "stale").otherwise("ok"))
    )
    return rows.withColumn("status", status).select(*steps.columns, "status")
