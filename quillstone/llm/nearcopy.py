"""Groups of near copies: documents whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Candidates come from SimHash fingerprints with deletion-variant signatures, as in ``simhash``, but
of ``SEGMENTS`` segments of ``BITS`` bits each over the five-word shingles. Documents of equal
sets are one class. Two classes are candidates if some segment differs by at most one bit: they
meet at the segment's exact value, or where the one that has the bit unset meets the other with
that bit set, its one-wildcard variant. Every link is verified on the sets themselves.

At similarity 0.8 a bit differs with a chance of 0.15, so one of 24 segments of 26 bits fits with
a chance of 0.86; at 0.85 with 0.97, at 0.9 with 0.998. The README has the recall measured against
all pairs. Candidates whose fingerprints differ in more than ``MOST_DIFFERENT`` of their bits, over
two and a half standard deviations beyond what similarity 0.8 gives, are not compared further.

Unlike classes meet by chance in a share of ``SEGMENTS * (BITS + 1) / 2 ** BITS`` of all pairs, so
``BITS`` should grow with the logarithm of the corpus.

Large groups are found by few comparisons: the pivot of a bucket is the class that meets most
others. Each class is compared with the most crowded pivot that it meets; then with its other
pivots, where it isn't in their group yet; then the members of a bucket that are still in
different groups with one another, but for pairs that the sizes or the triangle inequality of the
Jaccard distance to a common pivot rule out. Both bounds are exact, so what is left out is in one
group already or can't link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.bpe import each_text
from quillstone.llm.simhash import SEED, components
from quillstone.session import cut_lineage

SHINGLE = 5
#: Similarity of four fifths, as whole numbers so that the comparison is exact.
PART, WHOLE = 4, 5
SEGMENTS, BITS = 24, 26
MOST_DIFFERENT = 0.19
#: Fingerprints or shingle sets of compared classes are broadcast up to so many bytes; the driver holds each several times over.
BROADCAST_BYTES = 12 << 20

_WORDS = -(-SEGMENTS * BITS // 64)
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = 1 << np.arange(BITS, dtype=np.int64)
_NUMBERS = np.arange(SEGMENTS, dtype=np.int64) << BITS


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stop = ends[SHINGLE - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stop)), np.uint64, len(stop)))


def votes(values: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit of the wide fingerprint."""
    total = np.zeros(_WORDS * 64, np.int64)
    for at in range(0, len(values), 255):  # sums of so many bits fit a byte
        part = values[at : at + 255, None] * _FACTORS
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        total += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return total


def segment_keys(values: np.ndarray) -> np.ndarray:
    """One number for each segment: its place, then its bits."""
    bits = 2 * votes(values)[: SEGMENTS * BITS] > len(values)
    return bits.reshape(SEGMENTS, BITS) @ _POWERS + _NUMBERS


@F.arrow_udf(T.StructType([T.StructField("cls", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
def _signatures(texts: pa.Array) -> pa.Array:
    classes, keys = [], []
    for x in each_text(texts.cast(pa.binary())):
        values = shingle_set(x or b"")
        classes.append(xxhash.xxh64_intdigest(values.tobytes(), SEED) - (1 << 63))
        keys.append(segment_keys(values) if len(values) else np.zeros(0, np.int64))
    ends = np.cumsum([0, *map(len, keys)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
    return pa.StructArray.from_arrays([pa.array(classes, pa.int64()), lists], ["cls", "keys"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(x or b"").view(np.int64) for x in each_text(texts.cast(pa.binary()))], pa.list_(pa.int64()))


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text; repeated rows share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _unset_bits(key: Column) -> Column:
    """The places of the segment's unset bits."""
    return F.filter(F.sequence(F.lit(0).cast("byte"), F.lit(BITS - 1).cast("byte")), lambda i: key.bitwiseAND(_bit(i)) == 0)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, size_a, size_b): how many shingles each pair shares and each side has."""
    most = sets.agg(F.avg(F.size("set"))).first()[0] or 0
    left, right = (_beside(sets.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}")), int(10 * most) + 64) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b")).alias("both")
    return pairs.join(right, "b").join(left, "a").select("a", "b", both, F.size("set_a").alias("size_a"), F.size("set_b").alias("size_b"))


def _beside(few: DataFrame, row_bytes: int) -> DataFrame:
    """``few``, to be broadcast if its rows, of about ``row_bytes`` each, are within ``BROADCAST_BYTES``."""
    return F.broadcast(few) if few.count() * row_bytes <= BROADCAST_BYTES else few


def _first_meeting() -> Column:
    """Whether ``key`` lies in the first segment in which the fingerprints keys_a and keys_b differ by one bit at most."""
    close = F.zip_with("keys_a", "keys_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= 1)
    return F.array_position(close, True) == F.shiftright("key", BITS) + 1


def _near_enough() -> Column:
    """Whether the fingerprints keys_a and keys_b differ in few enough bits."""
    apart = F.aggregate(F.zip_with("keys_a", "keys_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return apart <= int(MOST_DIFFERENT * SEGMENTS * BITS)


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints are near enough to be looked at."""
    pairs = cut_lineage(pairs)
    named = cut_lineage(classes.join(_members(pairs), "cls").select("cls", F.col("m.keys").alias("keys")))
    left, right = (_beside(named.select(F.col("cls").alias(c), F.col("keys").alias(f"keys_{c}")), 16 * SEGMENTS) for c in "ab")
    return pairs.join(right, "b").join(left, "a").filter(_near_enough()).select("a", "b")


def _similar() -> Column:
    return F.col("both") * WHOLE >= (F.col("size_a") + F.col("size_b") - F.col("both")) * PART


def _value_pairs(pivots: DataFrame) -> DataFrame:
    """(few, many): the values one bit apart, each pair once; few is the one that fewer classes have."""
    variants = pivots.select("key", F.explode(_unset_bits(F.col("key"))).alias("bit"))
    variants = variants.select(F.col("key").bitwiseOR(_bit(F.col("bit"))).alias("key"), "bit")
    side = F.struct("n", "crowd", "key", "pivot")
    pairs = cut_lineage(variants.join(pivots, "key").select(F.col("key").bitwiseXOR(_bit(F.col("bit"))).alias("low"), side.alias("high")))
    both = pivots.select(F.col("key").alias("low"), side.alias("side")).join(_beside(pairs, 64), "low")
    return cut_lineage(both.select(F.least("side", "high").alias("few"), F.greatest("side", "high").alias("many")))


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, cls, exact, pivot, crowd): the segments at which classes meet; the pivot is the most crowded that has the exact value.

    Values one bit apart are paired before their classes are looked up: however many classes have
    a value, it has ``BITS`` neighbours at most. Of a pair the classes of the rarer value come to
    the bucket of the other one.
    """
    exact = classes.select("cls", F.explode("m.keys").alias("key"))
    counts = exact.groupBy("key").agg(F.count("*").alias("n"))
    crowd = exact.join(counts.filter("n > 1"), "key").groupBy("cls").agg(F.sum("n").alias("crowd"))
    ranked = exact.join(crowd, "cls", "left").select("key", "cls", F.coalesce("crowd", F.lit(0).cast("bigint")).alias("crowd"))
    pivots = ranked.groupBy("key").agg(F.max(F.struct("crowd", "cls")).alias("p"), F.count("*").alias("n"))
    pivots = cut_lineage(pivots.select("key", F.col("p.cls").alias("pivot"), F.col("p.crowd").alias("crowd"), "n"))
    same = cut_lineage(exact.join(pivots.filter("n > 1"), "key").select("key", "cls", F.lit(True).alias("exact"), "pivot", "crowd"))
    pairs = _value_pairs(pivots)
    lone = pairs.filter("few.n = 1").select("many", F.col("few.pivot").alias("cls"))
    several = pairs.filter("few.n > 1").select(F.col("few.key").alias("rarer"), "many")
    several = several.join(same.select(F.col("key").alias("rarer"), "cls"), "rarer").select("many", "cls")
    near = lone.unionByName(several).select("many.key", "cls", F.lit(False).alias("exact"), "many.pivot", "many.crowd")
    return cut_lineage(same.unionByName(near))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, row, cls) of every row, and (cls, root, first) of every class, where first is its least id and row."""
    table = docs.select(F.col(id_col), row_key(id_col, text_col).alias("row"), _signatures(F.col(text_col)).alias("sig"))
    table = cut_lineage(table.select(id_col, "row", "sig.cls", "sig.keys"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("row"))).alias("first")
    classes = cut_lineage(table.groupBy("cls").agg(first, F.min(F.struct("row", "keys")).alias("m")))
    members = _buckets(classes)

    texts = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), cheap to read again, with what they share, and whether that is enough."""
        chosen = _members(pairs).join(classes, "cls").select("cls", "m.row")
        sets = cut_lineage(texts.join(chosen, "row").dropDuplicates(["cls"]).select("cls", _sets(F.col("text")).alias("set")))
        return cut_lineage(_compared(pairs, sets).withColumn("similar", _similar()))

    def with_roots(rows: DataFrame, roots: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            rows = rows.join(roots.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return rows

    # each class with the most crowded pivot that it meets
    best = members.filter("cls != pivot").groupBy("cls").agg(F.max(F.struct("crowd", "pivot")).alias("p"))
    first = linked(cut_lineage(_plausible(best.select(F.col("p.pivot").alias("a"), F.col("cls").alias("b")), classes)))
    edges = first.filter("similar").select("a", "b")
    roots = components(classes, edges)
    # each class with the other pivots that it meets, where it isn't in their group yet
    others = with_roots(members.filter("cls != pivot").select("cls", "pivot").distinct(), roots, "cls", "pivot").filter("root_cls != root_pivot")
    second = linked(cut_lineage(_plausible(others.select(F.col("pivot").alias("a"), F.col("cls").alias("b")), classes)))
    edges = edges.unionByName(second.filter("similar").select("a", "b"))
    roots = components(classes, edges)
    # all members of a bucket that are still in different groups, but for the pivot
    far = 1 - F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))
    seen = first.select(F.col("a").alias("near"), F.col("b").alias("cls"), far.alias("far"), F.col("size_b").alias("size"))
    known = with_roots(members.filter("cls != pivot"), roots, "cls").join(seen, "cls", "left")
    known = cut_lineage(known.select("key", "cls", "exact", "near", "far", "size", F.col("root_cls").alias("root")))
    mixed = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    rest = cut_lineage(known.join(mixed, "key", "left_semi").join(classes.select("cls", F.col("m.keys").alias("keys")), "cls"))
    one, two = (rest.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "exact", "near", "far", "size", "root", "keys"))) for s in "ab")
    near = (F.abs(F.col("far_a") - F.col("far_b")) <= 1 - PART / WHOLE + 1e-9) & (F.least("size_a", "size_b") * WHOLE >= F.greatest("size_a", "size_b") * PART)
    close = F.coalesce(near | (F.col("near_a") != F.col("near_b")), F.lit(True))
    two = two.withColumnRenamed("key", "other")
    meet = (F.col("key") == F.col("other")) & F.col("exact_a") & (~F.col("exact_b") | (F.col("cls_a") < F.col("cls_b"))) & (F.col("root_a") != F.col("root_b"))
    # a pair is made once, in the first bucket where it can meet
    pairs = one.join(two, meet & close & _near_enough() & _first_meeting()).select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()
    later = linked(cut_lineage(pairs)).filter("similar").select("a", "b")

    roots = components(classes, edges.unionByName(later))
    rooted = classes.select("cls", "first").join(roots.withColumnRenamed("fp", "cls"), "cls", "left")
    return table, cut_lineage(rooted.select("cls", F.coalesce("root", "cls").alias("root"), "first"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id) for every row of ``docs``; a group has the name of its least id.

    Null texts and those without words are one group. Repeated rows and rows of one id are all
    returned, each with its own text's group. A null id never names a group that has another id.
    An empty table gives none; other columns of ``docs`` are not read.
    """
    table, rooted = _groups(docs, id_col, text_col)
    named = rooted.groupBy("root").agg(F.min("first").alias("f")).select("root", F.col("f.id").alias("component_id"))
    lookup = cut_lineage(rooted.join(named, "root").select("cls", "component_id"))
    return table.join(lookup, "cls").select(id_col, "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, whole, of each group of near copies: that of least id, and of its texts' least hash.

    A row without an id stays only where no other row of its group has one. Of equal rows one
    stays; different texts of one id are rows of their own. An empty table gives none.
    """
    _, rooted = _groups(docs, id_col, text_col)
    chosen = rooted.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.row").alias("_row"))
    kept = docs.withColumn("_row", row_key(id_col, text_col)).join(chosen, "_row", "left_semi")
    return kept.dropDuplicates(["_row"]).select(docs.columns)
