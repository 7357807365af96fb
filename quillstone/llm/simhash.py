"""SimHash fingerprints of word shingles and near-duplicate components.

Two fingerprints link when at most two of their 64 bits differ. The link search cuts a
fingerprint into two 32-bit segments, so one of them differs by at most one bit:

* a pair that agrees in a segment meets at that segment's exact key;
* a pair that differs by one bit there meets at the key with this bit wiped out, where one
  side brings the 0 and the other the 1, so each such pair is made once.

Every joined pair is verified on all 64 bits. A segment value that more than ``HOT_SEGMENT``
distinct fingerprints share would make too many pairs. Its members, and those one bit away,
take another exact way: each sends itself under its 65 neighbours at distance 0 or 1. Two
fingerprints link exactly if they have such a neighbour in common, all that meet at a
neighbour link with one another, and at most 65 distinct fingerprints can meet there, so a
star to the least one stands for all their pairs whatever the group's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.bpe import each_text
from quillstone.session import cut_lineage

SEED = 42
HOT_SEGMENT = 24
MAX_DISTANCE = 2


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Majority vote over the hashes of word shingles; 0 for a text without words."""
    words = text.lower().split()  # on bytes: A-Z alone, and space with \\t to \\r alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed=SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stop = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stop)), np.uint64, len(stop))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    out = [fingerprint_of(x or b"") for x in each_text(texts.cast(pa.binary()))]
    return pa.array(np.array(out, np.uint64).view(np.int64))


def fingerprint(text: Column) -> Column:
    """The 64-bit fingerprint as a signed long; null text counts as empty and gives 0."""
    return _fingerprints(text)


def links(fingerprints: DataFrame, hot: int = HOT_SEGMENT) -> DataFrame:
    """Edges (a, b) over distinct longs ``fp`` whose closure is that of all links.

    ``fingerprints`` has one row for each distinct value, and should be cheap to read again.
    """
    segment = F.explode(
        F.array(
            F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("v")),
            F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")),
        )
    )
    rows = fingerprints.select("fp", segment.alias("s")).select("fp", "s.seg", "s.v")
    bits = F.sequence(F.lit(0), F.lit(31))
    crowded = rows.groupBy("seg", "v").count().filter(F.col("count") > hot).select("seg", "v")
    flips = F.transform(bits, lambda i: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    reach = crowded.select("seg", F.explode(F.concat(F.array("v"), flips)).alias("v")).distinct()
    crowded, reach = cut_lineage(crowded), cut_lineage(reach)
    calm = rows.join(crowded, ["seg", "v"], "left_anti")

    # one-wildcard variants: bit -1 is the exact segment, else the bit that is wiped out
    exact = calm.select("fp", "seg", "v")
    left, right = exact.withColumnRenamed("fp", "a"), exact.withColumnRenamed("fp", "b")
    same = left.join(right, ["seg", "v"]).filter("a < b").select("a", "b")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    wild = calm.select("fp", "seg", "v", F.explode(bits).alias("bit")).select(
        "fp",
        "seg",
        "bit",
        F.col("v").bitwiseAND(F.bitwise_not(one)).alias("rest"),
        (F.col("v").bitwiseAND(one) != 0).alias("high"),
    )
    low = wild.filter(~F.col("high")).select(F.col("fp").alias("a"), "seg", "bit", "rest")
    high = wild.filter("high").select(F.col("fp").alias("b"), "seg", "bit", "rest")
    near = low.join(high, ["seg", "bit", "rest"]).select("a", "b")
    verified = same.unionByName(near).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)

    members = rows.join(reach, ["seg", "v"], "left_semi").select("fp").distinct()
    wide = F.sequence(F.lit(0), F.lit(63))
    around = F.concat(
        F.array("fp"),
        F.transform(wide, lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))),
    )
    sent = members.select("fp", F.explode(around).alias("key"))
    least = sent.groupBy("key").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    star = least.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter("a != b")
    return verified.unionByName(star).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) for every ``fp`` that has an edge: the least value reachable.

    Alternates large-star and small-star steps, which keep the number of edges bounded and end
    after a logarithmic number of rounds; each round is cut at the shared checkpoint folder.
    """
    edges = cut_lineage(edges.select("a", "b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node go to the least of its neighbourhood
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its neighbours below go to the least of those
        low = large.filter("b < a").distinct()
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.filter("a != b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_SEGMENT) -> DataFrame:
    """(id_col, fp, component_id) for every row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other. Rows of equal text share a
    fingerprint and so a component; repeated rows are all returned. A null id is returned with
    its fingerprint and never names a component that has another id. An empty table gives none.
    """
    table = cut_lineage(docs.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp")))
    classes = cut_lineage(table.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = components(classes, links(classes.select("fp"), hot))
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    lookup = cut_lineage(rooted.join(named, "root").select("fp", "component_id"))
    return table.join(lookup, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
