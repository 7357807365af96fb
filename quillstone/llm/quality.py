"""Quality rules: base counts, and robust multivariate outliers by language and source.

Each text gives a vector of transformed statistics. For each (language, source) the minimum
covariance determinant estimate is sought among all its documents: the share ``COVER`` of them
whose covariance has the least determinant. Concentration steps take the documents of least
Mahalanobis distance from an estimate, and their mean and covariance as the next; the determinant
never rises. They begin from three robust starts (medians with quartile ranges alone, with the
correlations of tanh scores, and with those of spatial signs). After ``TRIAL_STEPS`` steps the start of least determinant goes on
until no group's determinant falls any more. The covariance is then scaled to be consistent for
normal data. A document is rejected if its distance from its group's estimate is over ``CUTOFF``.
Groups of fewer than ``LEAST`` documents use their language's estimate, and such languages that
of all documents.

Every pass is an aggregation by group and bin, or of a few sums by group, which is combined
before the shuffle, so a group with most of the rows costs no more than the others. The estimates
stay a table; it is broadcast only while it has at most ``BROADCAST_GROUPS`` rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.bpe import each_text
from quillstone.session import cut_lineage

COVER = 0.75
TRIAL_STEPS = 2
MOST_STEPS = 12
LEAST = 60
CUTOFF = 4.8
#: Bins of an octave of squared distance, and of a unit of a statistic.
FINE, UNIT = 256, 1024
BROADCAST_GROUPS = 20_000

#: Transformed statistics, and the least standard deviation that each is given.
FEATURES = {"word_length": 0.06, "symbols": 0.04, "capitals": 0.05, "marks": 0.06, "dup_lines": 0.20, "repeats": 0.20, "variety": 0.03}
P = len(FEATURES)
TRIANGLE = [(i, j) for i in range(P) for j in range(i + 1)]

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_MARKS = b"!?;:=~^_+@/\\"
FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType())]
FIELDS += [(name, T.DoubleType()) for name in FEATURES]


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a 3-word window found twice or more, and the number of distinct words."""
    n = len(words)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if n < 4:
        return 0, len(index)
    pair = ids[:-1] * len(index) + ids[1:]
    if len(index) >= 1 << 21:  # keep the product of three within 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    code = pair[:-1] * len(index) + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n + 2, bool)
    hit = np.zeros(len(code), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    for shift in range(3):
        twice[shift : shift + len(code)] |= hit
    return int(twice.sum()), len(index)


def text_statistics(text: str | None) -> tuple:
    """The base counts and the transformed statistics of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeats, distinct = repeat_words(words)
    chars, symbols = len(text) - count(_SPACE), count(_SYMBOLS)
    angle = lambda share: float(np.arcsin(np.sqrt(min(1.0, share))))
    if not n:
        return (0, 0, 0, 0, 0, *[0.0] * P)
    return (
        n,
        chars,
        symbols,
        dup_lines,
        repeats,
        float(np.log(chars / n)),
        angle(symbols / chars),
        angle(count(_CAPITALS) / chars),
        angle(count(_MARKS) / chars),
        angle(dup_lines / len(lines)),
        angle(repeats / n),
        float(np.log(distinct + 1) / np.log(n + 1)),
    )


@F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in FIELDS]))
def _statistics(texts: pa.Array) -> pa.Array:
    columns = zip(*map(text_statistics, each_text(texts))) if len(texts) else [[]] * len(FIELDS)
    kinds = [pa.int64() if isinstance(t, T.LongType) else pa.float64() for _, t in FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [n for n, _ in FIELDS])


def statistics(text: Column) -> Column:
    """struct of base counts and transformed statistics; a null text counts as empty."""
    return _statistics(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


_VECTOR = T.ArrayType(T.DoubleType())
_ESTIMATE = T.StructType([T.StructField(n, t) for n, t in (("n", T.LongType()), ("mean", _VECTOR), ("whitening", _VECTOR), ("logdet", T.DoubleType()))])


def _chi2_below(x: float, k: int) -> float:
    """Chance that a chi-square variable of k degrees of freedom is below x."""
    term = total = 1.0 / (k / 2)
    for i in range(1, 200):
        term *= x / 2 / (k / 2 + i)
        total += term
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))


def consistency(cover: float) -> float:
    """What the covariance of the nearest ``cover`` of normal data must be multiplied by."""
    if cover >= 1:
        return 1.0
    low, high = 0.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(mid, P) < cover else (low, mid)
    return cover / _chi2_below(high, P + 2)


def _whitened(cov: np.ndarray) -> tuple[list[float], float]:
    """Lower triangle of the inverse Cholesky factor, and the logarithm of the determinant; variances are at least the floors."""
    cov = cov.copy()
    floor = np.array(list(FEATURES.values())) ** 2
    np.fill_diagonal(cov, np.maximum(np.diag(cov), floor))
    factor = np.linalg.cholesky(cov + 1e-12 * np.eye(P))
    inverse = np.linalg.inv(factor)
    return [float(inverse[i, j]) for i, j in TRIANGLE], float(2 * np.log(np.diag(factor)).sum())


@F.pandas_udf(_ESTIMATE)
def _from_sums(total_n: pd.Series, n: pd.Series, sums: pd.Series) -> pd.DataFrame:
    """The estimate from the weight and the weighted sums of a group's chosen documents."""
    out = []
    for every, count, total in zip(total_n, n, sums):
        total = np.asarray(total, float) / count
        mean = total[:P]
        moment = np.zeros((P, P))
        for value, (i, j) in zip(total[P:], TRIANGLE):
            moment[i, j] = moment[j, i] = value
        out.append((every, mean.tolist(), *_whitened(moment - np.outer(mean, mean))))
    return pd.DataFrame(out, columns=_ESTIMATE.fieldNames())


@F.pandas_udf(T.ArrayType(_ESTIMATE))
def _starts(n: pd.Series, middle: pd.Series, scale: pd.Series, tanh: pd.Series, signs: pd.Series) -> pd.Series:
    """Three estimates of a group: of quartile ranges alone, with correlations of tanh scores, and with those of spatial signs."""
    out = []
    for count, m, s, t, g in zip(n, middle, scale, tanh, signs):
        d = np.diag(np.asarray(s, float))
        shapes = [np.eye(P)]
        for triangle, centre in ((np.asarray(t, float)[P:], np.asarray(t, float)[:P]), (np.asarray(g, float), np.zeros(P))):
            shape = np.zeros((P, P))
            for value, (i, j) in zip(triangle / count, TRIANGLE):
                shape[i, j] = shape[j, i] = value
            shape -= np.outer(centre, centre) / count**2
            spread = np.sqrt(np.maximum(np.diag(shape), 1e-6))
            shapes.append(shape / np.outer(spread, spread) * (1 - 1e-3) + 1e-3 * np.eye(P))
        out.append([dict(zip(_ESTIMATE.fieldNames(), (count, list(m), *_whitened(d @ x @ d)))) for x in shapes])
    return pd.Series(out)


def _distance() -> Column:
    """Squared Mahalanobis distance of the columns x0.. from mean and whitening, free of UDFs."""
    total = F.lit(0.0)
    for i in range(P):
        line = F.lit(0.0)
        for k, (a, b) in enumerate(TRIANGLE):
            if a == i:
                line = line + F.col("e.whitening")[k] * (F.col(f"x{b}") - F.col("e.mean")[b])
        total = total + line * line
    return total


def _few(groups: DataFrame) -> DataFrame:
    """``groups``, a row for each group and small, in no more tasks than run at once: Python starts in each."""
    return groups.coalesce(groups.sparkSession.sparkContext.defaultParallelism)


def _with(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    few = estimates.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(estimates) if few else estimates, "key")


def _quartiles(rows: DataFrame) -> DataFrame:
    """(key, n, middle, scale): medians and normal quartile ranges of each statistic, by counts of fixed bins.

    The counts of a key's bins are few whatever its rows, and only they meet.
    """
    each = rows.select("key", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * UNIT).cast("int") for i in range(P)])).alias("i", "bin"))
    bins = each.groupBy("key", "i", "bin").agg(F.count("*").alias("c"))
    lists = bins.groupBy("key", "i").agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("b"), F.sum("c").alias("n"))

    def quantile(q: float) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("c"), F.lit(0).alias("bin"))
        step = lambda a, x: F.when(a["c"] > F.col("n") * q, a).otherwise(F.struct((a["c"] + x["c"]).alias("c"), x["bin"].alias("bin")))
        return (F.aggregate("b", zero, step)["bin"] + F.lit(0.5)) / F.lit(float(UNIT))

    found = lists.select("key", "i", "n", quantile(0.5).alias("m"), ((quantile(0.75) - quantile(0.25)) / F.lit(1.349)).alias("s"))
    floors = F.array(*[F.lit(float(v)) for v in FEATURES.values()])
    found = found.withColumn("s", F.greatest("s", F.get(floors, F.col("i"))))
    sides = found.groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("q"))
    return sides.select("key", "n", F.col("q.m").alias("middle"), F.col("q.s").alias("scale"))


def _first_estimates(rows: DataFrame) -> DataFrame:
    """(key, start, e): the robust starts of each group."""
    quarters = cut_lineage(_few(_quartiles(rows)))
    z = _with(rows, quarters).select("key", *[((F.col(f"x{i}") - F.col("middle")[i]) / F.col("scale")[i]).alias(f"z{i}") for i in range(P)])
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-12)))
    z = z.select("key", *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)], *[(F.col(f"z{i}") / norm).alias(f"u{i}") for i in range(P)])
    tanh = [F.sum(f"t{i}") for i in range(P)] + [F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in TRIANGLE]
    signs = [F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i, j in TRIANGLE]
    sums = z.groupBy("key").agg(*[x.alias(f"a{k}") for k, x in enumerate(tanh)], *[x.alias(f"b{k}") for k, x in enumerate(signs)])
    sums = sums.select("key", F.array(*[f"a{k}" for k in range(len(tanh))]).alias("t"), F.array(*[f"b{k}" for k in range(len(signs))]).alias("g"))
    both = _few(quarters.join(sums, "key")).select("key", _starts("n", "middle", "scale", "t", "g").alias("s"))
    return cut_lineage(both.select("key", F.posexplode("s").alias("start", "e")))


def concentrated(rows: DataFrame, now: DataFrame, cover: float = COVER) -> DataFrame:
    """(key, start, e) after one concentration step of each estimate (key, start, e).

    The cut at the cover share is found from counts of fine bins of distance; of the bin that it
    falls into, each document counts with the share that is wanted.
    """
    fine = F.floor(F.log2(_distance() + F.lit(1e-9)) * FINE).cast("int")
    counts = _with(rows, now).groupBy("key", "start", fine.alias("bin")).agg(F.count("*").alias("c"))
    lists = counts.groupBy("key", "start").agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("b"), F.sum("c").alias("n"))
    wanted = F.greatest(F.ceil(F.col("n") * cover), F.least(F.col("n"), F.floor((F.col("n") + P + 1) / 2))).cast("bigint")
    zero = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("c"), F.lit(0).alias("bin"))
    step = lambda a, x: F.when(a["before"] + a["c"] >= F.col("h"), a).otherwise(
        F.struct((a["before"] + a["c"]).alias("before"), x["c"].alias("c"), x["bin"].alias("bin"))
    )
    cuts = lists.withColumn("h", wanted).select("key", "start", "n", "h", F.aggregate("b", zero, step).alias("cut"))
    cuts = cuts.select("key", "start", "n", F.col("cut.bin").alias("cut"), ((F.col("h") - F.col("cut.before")) / F.col("cut.c")).alias("part"))
    near = _with(rows, cut_lineage(_few(now.join(cuts, ["key", "start"])))).withColumn("bin", fine).filter("bin <= cut")
    near = near.withColumn("w", F.when(F.col("bin") < F.col("cut"), 1.0).otherwise(F.col("part")))
    sums = [F.sum(F.col("w") * F.col(f"x{i}")) for i in range(P)] + [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in TRIANGLE]
    made = near.groupBy("key", "start").agg(F.max("n").alias("n"), F.sum("w").alias("w"), *[x.alias(f"s{k}") for k, x in enumerate(sums)])
    return cut_lineage(_few(made).select("key", "start", _from_sums("n", "w", F.array(*[f"s{k}" for k in range(len(sums))])).alias("e")))


def estimates(vectors: DataFrame, cover: float = COVER, trials: int = TRIAL_STEPS, most: int = MOST_STEPS) -> DataFrame:
    """(key, e) by minimum covariance determinant; ``vectors`` has keys and x0 .. of each document."""
    rows = vectors.withColumn("key", F.explode("keys")).drop("keys")
    now = _first_estimates(rows)
    for _ in range(trials):
        now = concentrated(rows, now, cover)
    now = cut_lineage(_few(now.groupBy("key").agg(F.min_by("e", F.struct("e.logdet", "start")).alias("e"))).select("key", F.lit(0).alias("start"), "e"))
    for _ in range(most):
        after = concentrated(rows, now, cover).select("key", F.col("e").alias("f"))
        falls = F.col("f.logdet") < F.col("e.logdet") - 1e-6
        both = cut_lineage(_few(now.join(after, "key")).select("key", "start", F.when(falls, F.col("f")).otherwise(F.col("e")).alias("e"), falls.alias("falls")))
        now = both.drop("falls")
        if both.filter("falls").isEmpty():
            break
    scale = F.lit(1 / math.sqrt(consistency(cover)))
    e = F.struct("e.n", "e.mean", F.transform("e.whitening", lambda x: x * scale).alias("whitening"), "e.logdet")
    return now.select("key", e.alias("e"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, keep_text: bool = True) -> DataFrame:
    """``docs`` with columns s (counts and statistics), base_failed, distance and kept.

    Null texts count as empty, and a text of any length is read whole; null language or source
    is a group value of its own. Documents that fail the base rules are neither kept nor part of
    the estimates, and their distance is null where there are no estimates at all. Repeated rows
    count each; an empty table gives an empty result. Of starts of equal determinant the first
    is taken. Columns of ``docs`` named like these four are replaced. The rows with their
    statistics, made once, go to the shared folder; without ``keep_text`` the text isn't among them.
    """
    own = ("s", "base_failed", "distance", "kept")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own and (keep_text or c != text_col)]
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    keys = F.array(F.lit(""), name(lang_col), F.concat_ws("\t", name(lang_col), name(source_col)))
    table = cut_lineage(docs.select(F.struct(*rest).alias("row"), statistics(F.col(text_col)).alias("s"), keys.alias("keys")))
    failed = base_failed(F.col("s"))
    x = [F.col(f"s.{f}").alias(f"x{i}") for i, f in enumerate(FEATURES)]
    found = estimates(cut_lineage(table.filter(~failed).select("keys", *x)))
    found = cut_lineage(found.filter((F.col("e.n") >= LEAST) | (F.col("key") == "")))
    few = found.count() <= BROADCAST_GROUPS
    out = table.select("row", "s", "keys", *x)
    for level in (2, 1, 0):  # the finest group that has an estimate
        side = found.select(F.col("key").alias(f"k{level}"), F.col("e").alias(f"e{level}"))
        out = out.join(F.broadcast(side) if few else side, F.col("keys")[level] == F.col(f"k{level}"), "left")
    out = out.withColumn("e", F.coalesce("e2", "e1", "e0"))
    out = out.select("row", "s", failed.alias("base_failed"), F.sqrt(_distance()).alias("distance"))
    return out.select("row.*", "s", "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))
