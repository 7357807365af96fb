"""StateFrame: sealed sequences with payloads, kept as Parquet in a folder all executors share.

Engines name the same three verbs differently; an EngineView offers them under an engine's own
names. Nothing is ever removed by an engine: its drop verb says no.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import codec
from quillstone.operators import prefix

COLUMNS = "ns string, depth int, hash string, owner bigint, n_tokens bigint, payload binary, seq bigint"

# Fixed names of the engines' verbs, in the order lookup, store, retrieve, drop.
ENGINE_VERBS = {
    "core": ("lookup", "seal", "fetch", "release"),
    "sglang": ("lookup", "store", "retrieve", "drop"),
    "aibrix": ("exists", "put", "get", "delete"),
    "dynamo": ("match", "offload", "onboard", "evict"),
    "lmdeploy": ("match", "add", "get", "free"),
    "mii": ("query", "put", "get", "release"),
    "tgi": ("prefix_lookup", "insert", "load", "evict"),
    "vllm": ("get_matched_tokens", "save_layers", "start_load", "request_finished"),
    "trtllm": ("Lookup", "Store", "Retrieve", "Drop"),
    "rust": ("lookup", "seal", "fetch", "release"),
}


class StateFrame:
    """Requests are rows of id, tenant, model and tokens, and for store of payload as well."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        """All writes so far; empty before the first."""
        try:
            return self.spark.read.schema(COLUMNS).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], COLUMNS)

    def sealed(self) -> DataFrame:
        """(ns, depth, hash, owner): the last write of each path, its owner with n_tokens and seq; no payloads."""
        last = F.max_by(F.struct("owner", "n_tokens", "seq"), "seq").alias("owner")
        return self.table().groupBy("ns", "depth", "hash").agg(last)

    def store(self, writes: DataFrame, seq: int = 0) -> DataFrame:
        """Appends what can be sealed; returns (id, status), INVAL where there is no whole chunk.

        ``seq`` orders the calls: a later one replaces a path that an earlier one wrote. Within
        a call the highest id, below 2**40 and given once, comes last.
        """
        ns = prefix.namespace(F.col("tenant"), F.col("model"))
        made = prefix.seal(writes, "id", ns, F.col("tokens")).withColumnRenamed("depth", "d")
        rows = made.filter("status = 'OK'").join(writes.select("id", F.size("tokens").cast("bigint").alias("n_tokens"), "payload"), "id")
        order = (F.lit(seq) * F.lit(1 << 40) + F.col("id")).cast("bigint")
        rows.select("ns", F.col("d").cast("int").alias("depth"), "hash", F.col("id").cast("bigint").alias("owner"), "n_tokens", "payload", order.alias("seq")).write.mode("append").parquet(self.path)
        return made.select("id", "status")

    def _match(self, queries: DataFrame) -> DataFrame:
        ns = prefix.namespace(F.col("tenant"), F.col("model"))
        return prefix.longest_prefix_match(queries, "id", ns, F.col("tokens"), self.sealed())

    def lookup(self, queries: DataFrame) -> DataFrame:
        """(id, matched_tokens, owner) of each query."""
        return self._match(queries).select("id", "matched_tokens", F.col("owner.owner").alias("owner"))

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """lookup() with ``payload``: the owner's bytes of the matched tokens, null on a miss.

        The rest of the owner's payload, of tokens beyond whole chunks, is cut off. Payloads are
        joined to the matches at the end, by the number of their write.
        """
        found = self._match(queries).select("id", "matched_tokens", F.col("owner.owner").alias("owner"), F.col("owner.seq").alias("seq"))
        held = self.table().select("seq", "n_tokens", "payload")
        both = found.join(held, "seq", "left")
        each = F.floor(F.length("payload") / F.col("n_tokens")).cast("int")
        cut = F.substring("payload", F.lit(1), (F.col("matched_tokens") * each).cast("int"))
        return both.select("id", "matched_tokens", "owner", cut.alias("payload"))

    def stored_bytes(self, queries: DataFrame) -> DataFrame:
        """(id, bytes) that retrieve() would give."""
        return self.retrieve(queries).select("id", F.coalesce(F.length("payload"), F.lit(0)).cast("bigint").alias("bytes"))

    def drop(self, queries: DataFrame) -> bool:
        """Engines can't remove state; retention does. Always False."""
        return False

    @staticmethod
    def compress_store(payload: Column) -> Column:
        return codec.compress(payload)

    @staticmethod
    def compress_retrieve(stored: Column) -> Column:
        return codec.decompress(stored)


class EngineView:
    """A StateFrame under an engine's verb names, plain and with ``_async`` (which runs the same plan)."""

    def __init__(self, frame: StateFrame, engine: str):
        for name, verb in zip(ENGINE_VERBS[engine], ("lookup", "store", "retrieve", "drop")):
            setattr(self, name, getattr(frame, verb))
            setattr(self, f"{name}_async", getattr(frame, verb))
