"""Document fingerprints by winnowing, in DataFrame functions alone.

The words of a text are hashed once each, and a polynomial hash rolls over them: that of a run of
``GRAM`` words comes from that of the run before by taking out its first word and taking in the
next. Of every ``WINDOW`` runs that follow each other the one of least mixed hash is chosen, the
rightmost of equals, with its position. Two texts that share ``GRAM + WINDOW - 1`` words in a row
share a chosen hash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 5
WINDOW = 16
SPACE = "[ \\t-\\r]+"
#: Base and modulus of the rolling hash: a prime, with base times modulus below 2**63.
BASE, MODULUS = 1_000_003, (1 << 43) - 57
#: Runs that are rolled from one start; longer texts have several starts, so that time stays in proportion.
PIECE = 32
#: Order keys hold a position in 31 bits, more than a text can have, below 32 bits of the mixed hash.
PLACES = 1 << 31


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _times_base(value: Column, times: int = 1) -> Column:
    for _ in range(times):
        value = value * F.lit(BASE) % F.lit(MODULUS)
    return value


def rolled(words: Column, gram: int = GRAM) -> Column:
    """array<long>: the polynomial hash of each run of ``gram`` words, or of all words if there are fewer."""

    def grams(x: Column) -> Column:
        w, out = x["w"], x["out"]
        last = F.greatest(F.size(w) - F.lit(gram), F.lit(0))  # the last run's place
        zero = F.lit(0).cast("bigint")
        fresh = lambda i: F.aggregate(F.slice(w, i + 1, gram), zero, lambda h, v: (_times_base(h) + v) % F.lit(MODULUS))

        def piece(i: Column) -> Column:
            def step(a: Column, k: Column) -> Column:
                rest = (a["h"] + F.lit(MODULUS) - F.get(out, k - 1)) % F.lit(MODULUS)
                h = (_times_base(rest) + F.get(w, k + (gram - 1))) % F.lit(MODULUS)
                return let(h, lambda v: F.struct(v.alias("h"), F.array_append(a["all"], v).alias("all")))

            end = F.least(i + (PIECE - 1), last)
            more = F.filter(F.sequence(i, end), lambda k: k > i)
            return let(fresh(i), lambda h: F.aggregate(more, F.struct(h.alias("h"), F.array(h).alias("all")), step)["all"])

        starts = F.sequence(F.lit(0), last, F.lit(PIECE))
        return F.when(F.size(w) > 0, F.flatten(F.transform(starts, piece))).otherwise(F.array().cast("array<bigint>"))

    hashes = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(MODULUS)))
    return let(let(hashes, lambda w: F.struct(w.alias("w"), F.transform(w, lambda v: _times_base(v, gram - 1)).alias("out"))), grams)


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<place, hash>> of the chosen runs, in the order of their places.

    A place is that of the run's first word, counted from 0. Null and empty texts, and texts of
    white space alone, have none. A text of fewer words than a run is one run. Equal texts have
    equal fingerprints; texts of any length are read whole.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")

    def chosen(h: Column) -> Column:
        key = lambda v, i: F.shiftrightunsigned(v, 32) * F.lit(PLACES) + F.lit(PLACES - 1) - i

        def pick(p: Column) -> Column:
            n = F.greatest(F.size(p) - F.lit(window), F.lit(0))
            least = F.transform(F.sequence(F.lit(0), n), lambda i: F.array_min(F.slice(p, i + 1, window)))
            place = lambda e: (F.lit(PLACES - 1) - e.bitwiseAND(F.lit(PLACES - 1))).cast("int")
            return F.transform(F.array_distinct(least), lambda e: let(place(e), lambda i: F.struct(i.alias("place"), F.get(h, i).alias("hash"))))

        none = F.array().cast("array<struct<place:int,hash:bigint>>")
        return F.when(F.size(h) > 0, let(F.transform(h, key), pick)).otherwise(none)

    return let(F.transform(rolled(words, gram), lambda r: F.xxhash64(r)), chosen)


def hash_of(entry: Column) -> Column:
    return entry["hash"]


def place_of(entry: Column) -> Column:
    """The run's first word, counted from 0."""
    return entry["place"]


def likeness(a: Column, b: Column) -> Column:
    """Shared share of the distinct chosen hashes, 0 to 1; 1 where both have none."""
    x, y = (F.array_distinct(F.transform(c, hash_of)) for c in (a, b))

    def share(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["x"], pair["y"]))
        every = F.size(pair["x"]) + F.size(pair["y"]) - both
        return F.when(every == 0, F.lit(1.0)).otherwise(both / every)

    return let(F.struct(x.alias("x"), y.alias("y")), share)


#: Bytes of rows that a block of with_next holds, or less where the cluster has more tasks.
BLOCK_BYTES = 64 << 20


def _passed(value: Column, marks: list) -> Column:
    """How many of the rising marks are at most ``value``; found by steps of their square root."""
    if not marks:
        return F.lit(0)
    step = int(len(marks) ** 0.5) + 1
    passed = lambda some: F.size(F.filter(some, lambda m: m <= value))
    every, coarse = F.array(*map(F.lit, marks)), F.array(*map(F.lit, marks[step - 1 :: step] or marks[-1:]))
    if len(marks) < step:
        return F.coalesce(passed(every), F.lit(0))
    return F.coalesce(let(passed(coarse) * step, lambda c: c + passed(F.slice(every, c + 1, step))), F.lit(0))


def _blocks(rows: DataFrame, order_col: str, tie: Column, size: Column) -> Column:
    """struct<at, part>: a row's block in the order of ``order_col`` and ``tie``.

    Marks are approximate quantiles of the order values, as many as the blocks' bytes need. A
    value that several marks fall on has blocks of its own, by range of the tie's 64 bits, and so
    has null, which comes first; the driver sees the marks alone.
    """
    spark = rows.sparkSession
    seen = rows.agg(F.sum(size).alias("bytes"), F.count("*").alias("n"), F.count(order_col).alias("known")).first()
    blocks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen["bytes"] or 0) // BLOCK_BYTES))
    marks = rows.stat.approxQuantile(order_col, [i / blocks for i in range(1, blocks)], 0.2 / blocks)
    hot = {m: c + 1 for m, c in Counter(marks).items() if c > 1}
    nulls = 1 + blocks * (seen["n"] - seen["known"]) // max(1, seen["n"])
    share = tie / F.lit(2.0**64) + F.lit(0.5)
    parts = F.when(F.col(order_col).isNull(), F.lit(int(nulls)))
    if hot:
        values = F.map_from_arrays(F.array(*[F.lit(float(m)) for m in hot]), F.array(*map(F.lit, hot.values())))
        parts = parts.otherwise(F.coalesce(F.try_element_at(values, F.col(order_col).cast("double")), F.lit(1)))
    else:
        parts = parts.otherwise(F.lit(1))
    beyond = F.size(F.filter(F.array(*[F.lit(float(m)) for m in hot]), lambda m: m < F.col(order_col))) if hot else F.lit(0)
    at = F.when(F.col(order_col).isNull(), F.lit(-1)).otherwise(_passed(F.col(order_col), sorted(set(marks))) + beyond)
    return F.struct(at.alias("at"), F.floor(share * parts).cast("int").alias("part"))


def with_next(rows: DataFrame, order_col: str, own_col: str, next_col: str, value: Column, tie: Column, size: Column) -> DataFrame:
    """``rows`` with ``value`` as ``own_col``, and that of the row that follows by ``order_col``; of the last the first's.

    ``value`` is made once for each row, after the rows that go to two blocks are picked. Rows of
    equal order values, and those of null, which come first, are ordered by ``tie``, a 64-bit hash.

    The order's range is cut into blocks of about ``BLOCK_BYTES`` of ``size``, which bring the
    rows of a block together by one shuffle. The first row of each block is also sent to the
    block before it, and that of the first to the last, so that one window finds every next row.
    The driver sees two numbers for each block. A single row is its own next.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("_tie", tie)
    own = marked.withColumn("_block", _blocks(marked, order_col, F.col("_tie"), size))
    first = F.min(F.struct(F.col(order_col).isNotNull().alias("known"), F.col(order_col).alias("value"), F.col("_tie").alias("tie")))
    firsts = own.groupBy("_block").agg(first.alias("first")).orderBy("_block.at", "_block.part").collect()
    before = [r["_block"] for r in firsts[-1:] + firsts[:-1]]
    pairs = F.array(*[F.struct(F.lit(r["first"]["value"]), F.lit(r["first"]["tie"]), F.lit(b["at"]), F.lit(b["part"])) for r, b in zip(firsts, before)])
    kind = rows.schema[order_col].dataType.simpleString()
    sent = spark.range(1).select(F.inline(pairs.cast(f"array<struct<_first:{kind},_with:bigint,_at:int,_part:int>>")))
    sent = sent.select("_first", "_with", F.struct(F.col("_at").alias("at"), F.col("_part").alias("part")).alias("_block"))
    edge = marked.join(F.broadcast(sent), F.col(order_col).eqNullSafe(F.col("_first")) & (F.col("_tie") == F.col("_with"))).drop("_first", "_with")
    both = own.withColumn("_edge", F.lit(False)).unionByName(edge.withColumn("_edge", F.lit(True)))
    both = both.withColumn(own_col, value)
    order = Window.partitionBy("_block").orderBy("_edge", F.col(order_col).asc_nulls_first(), "_tie")
    return both.withColumn(next_col, F.lead(own_col).over(order)).filter(~F.col("_edge")).drop("_block", "_edge", "_tie")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the start of ``following``, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Null texts count as empty. Repeated ids and rows are all returned, those of one id in the
    order of their texts' hashes, and null ids first; an empty table gives none.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    marked = F.struct(F.col("_text").alias("text"), fingerprint(F.col("_text"), gram, window).alias("fingerprint"))
    paired = with_next(rows, id_col, "_own", "_next", marked, F.xxhash64("_text"), F.octet_length("_text")).drop("_text")
    made = paired.withColumn("_edited", edited(F.col("_own.text"), F.col("_next.text")))
    made = made.withColumn("_print", fingerprint(F.col("_edited"), gram, window))
    return made.select(
        id_col,
        F.length("_own.text").cast("long").alias("n_chars"),
        F.col("_edited").alias("edited"),
        F.col("_own.fingerprint").alias("fingerprint"),
        F.col("_print").alias("edited_fingerprint"),
        likeness(F.col("_own.fingerprint"), F.col("_print")).alias("near_edited"),
        likeness(F.col("_own.fingerprint"), F.col("_next.fingerprint")).alias("near_next"),
    )


def as_text(fp: Column) -> Column:
    """The fingerprint as place:hash, comma-joined, the hash in hexadecimal."""
    return F.array_join(F.transform(fp, lambda e: F.concat_ws(":", place_of(e), F.lower(F.hex(hash_of(e))))), ",")
