"""Longest-prefix matching over chunked token sequences, and the sealed index it reads.

A sequence is cut into chunks of 16 tokens; a path is named by its depth and a hash chained over
its chunks. The sealed side has one row for each path, the query side one for each of a query's
prefixes, so the match is one equi-join on (namespace, depth, hash) and one maximum per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.binding import let, once
from quillstone.functions.hashing import identity_hash

CHUNK = 16


def chunk_hashes(tokens: Column, size: int = CHUNK) -> Column:
    """Hashes of a sequence's whole chunks in order; the rest of the tokens is left out (P5)."""

    def chunks(t: Column) -> Column:
        count = F.floor(F.size(t) / size).cast("int")
        one = lambda i: F.md5(F.array_join(F.slice(t, i * size + 1, size), " "))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<string>"))

    return let(tokens, chunks)


def namespace(tenant: Column, model: Column) -> Column:
    """The namespace in which paths are compared."""
    return identity_hash(tenant, model)


def prefix_hashes(chunks: Column) -> Column:
    """array<struct<depth, hash>> of all prefixes of a chunk path, each hash chained to the last."""
    zero = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(state: Column, chunk: Column) -> Column:
        now = F.md5(F.concat(state["last"], chunk))
        return F.struct(now.alias("last"), F.concat(state["all"], F.array(now)).alias("all"))

    chained = F.aggregate(chunks, zero, step, lambda s: s["all"])
    return F.transform(chained, lambda h, i: F.struct((i + 1).alias("depth"), h.alias("hash")))


def path_hash(chunks: Column) -> Column:
    """The chained hash of a whole chunk path; null for an empty one."""
    return F.when(F.size(chunks) > 0, F.aggregate(chunks, F.lit(""), lambda last, chunk: F.md5(F.concat(last, chunk))))


def paths(rows: DataFrame, id_col: str, ns: Column, tokens: Column) -> DataFrame:
    """(id, ns, depth, hash) of each row's whole path; depth 0 and a null hash without chunks."""
    chunks = rows.select(F.col(id_col), ns.alias("ns"), once(chunk_hashes(tokens)).alias("chunks"))
    return chunks.select(id_col, "ns", F.size("chunks").alias("depth"), path_hash(F.col("chunks")).alias("hash"))


def seal(rows: DataFrame, id_col: str, ns: Column, tokens: Column) -> DataFrame:
    """paths() with a status: INVAL where there is no whole chunk, else OK (S3)."""
    return paths(rows, id_col, ns, tokens).withColumn("status", F.when(F.col("depth") == 0, "INVAL").otherwise("OK"))


def sealed_index(sealed: DataFrame, id_col: str) -> DataFrame:
    """(ns, depth, hash, owner): one row for each path, the highest id being the last to seal it."""
    return sealed.filter("depth > 0").groupBy("ns", "depth", "hash").agg(F.max(id_col).alias("owner"))


def longest_prefix_match(queries: DataFrame, id_col: str, ns: Column, tokens: Column, index: DataFrame) -> DataFrame:
    """(id, matched_tokens, owner): the deepest sealed path that is a prefix of each query.

    Only whole sealed paths match, so a query shorter than a sealed path misses it. Misses have
    0 tokens and a null owner.
    """
    parts = queries.select(F.col(id_col), ns.alias("ns"), once(prefix_hashes(chunk_hashes(tokens))).alias("p"))
    probes = parts.select(id_col, "ns", F.explode("p").alias("p")).select(id_col, "ns", "p.depth", "p.hash")
    hits = probes.join(index, ["ns", "depth", "hash"]).groupBy(id_col).agg(F.max("depth").alias("depth"), F.max_by("owner", "depth").alias("owner"))
    found = queries.select(id_col).join(hits, id_col, "left")
    return found.select(id_col, (F.coalesce("depth", F.lit(0)) * CHUNK).cast("bigint").alias("matched_tokens"), "owner")


def new_matched_tokens(matched: Column, computed: Column) -> Column:
    """Matched tokens beyond those already computed."""
    return F.greatest(matched - computed, F.lit(0))


def exact_match(queries: DataFrame, index: DataFrame) -> DataFrame:
    """The index row of each query's whole path; ``queries`` as from paths()."""
    return queries.join(index, ["ns", "depth", "hash"])


def upsert(index: DataFrame, new: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The index after ``new`` paths, and (id, result) of each: inserted, replaced or conflict.

    An empty path conflicts. Of several rows for a path the highest id comes last; the others
    but the lowest replace it too.
    """
    key = ["ns", "depth", "hash"]
    usable = new.filter("depth > 0")
    fresh = usable.groupBy(*key).agg(F.max(id_col).alias("new_owner"), F.min(id_col).alias("first"))
    both = index.join(fresh, key, "full_outer")
    after = both.select(*key, F.coalesce("new_owner", "owner").alias("owner"))
    old = index.select(*key, F.lit(True).alias("there"))
    marked = usable.join(fresh, key).join(old, key, "left")
    results = marked.select(id_col, F.when(F.col("there") | (F.col(id_col) > F.col("first")), "replaced").otherwise("inserted").alias("result"))
    conflicts = new.filter("depth = 0").select(id_col, F.lit("conflict").alias("result"))
    return after, results.unionByName(conflicts)


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without these exact paths; deeper ones stay."""
    return index.join(gone.select("ns", "depth", "hash").distinct(), ["ns", "depth", "hash"], "left_anti")


def index_stats(rows: DataFrame, ns: Column, tokens: Column) -> DataFrame:
    """One row: leaves and inner or leaf nodes of the index over these sequences, and its depth."""
    parts = rows.select(ns.alias("ns"), once(prefix_hashes(chunk_hashes(tokens))).alias("p"))
    nodes = parts.select("ns", F.explode("p").alias("p"), F.size("p").alias("n"))
    each = nodes.groupBy("ns", "p.depth", "p.hash").agg(F.max((F.col("p.depth") == F.col("n")).cast("int")).alias("leaf"))
    return each.agg(F.count("*").alias("nodes"), F.sum("leaf").alias("leaves"), F.max("depth").alias("depth"))
