"""Time-series aggregation: counters, gauges, histograms, rates, quantiles and alerts."""

from __future__ import annotations


from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed probabilities of a latency summary.
SUMMARY = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def counter(samples: DataFrame, labels: list[str], value_col: str) -> DataFrame:
    """(labels, total): what was added by label set (A4)."""
    return samples.groupBy(*labels).agg(F.sum(value_col).alias("total"))


def gauge(samples: DataFrame, labels: list[str], value_col: str, order: list[str]) -> DataFrame:
    """(labels, value): the last set value by ``order`` (A5)."""
    return samples.groupBy(*labels).agg(F.max_by(value_col, F.struct(*order)).alias("value"))


def histogram(samples: DataFrame, labels: list[str], value_col: str, bounds: list[float]) -> DataFrame:
    """(labels, le, count, total, n): cumulative buckets, one row for each bound and +Inf.

    A value equal to a bound counts in the next bucket.
    """
    counts = [F.count_if(F.col(value_col) < b) for b in bounds] + [F.count("*")]
    names = [F.lit(str(b)) for b in bounds] + [F.lit("+Inf")]
    buckets = F.array(*[F.struct(n.alias("le"), c.alias("count")) for n, c in zip(names, counts)])
    rows = samples.groupBy(*labels).agg(buckets.alias("b"), F.sum(value_col).alias("total"), F.count("*").alias("n"))
    return rows.select(*labels, F.explode("b").alias("b"), "total", "n").select(*labels, "b.le", "b.count", "total", "n")


#: Value ranges that latency_summary counts by first.
RANGES = 4096


def latency_summary(samples: DataFrame, labels: list[str], value_col: str, probabilities: dict[str, float] = SUMMARY) -> DataFrame:
    """(labels, n, min, max, total, quantiles): order statistics at index min(n-1, floor(p*n)).

    A label set's values are first counted by equal ranges between its least and greatest; only
    the ranges that hold a wanted index are then ordered, by their different values. So no task
    orders all values of a label set, however many it has. Nulls are left out.
    """
    value = F.col(value_col)
    rows = samples.select(*labels, value_col).filter(value.isNotNull())
    whole = rows.groupBy(*labels).agg(F.count("*").alias("n"), F.min(value_col).alias("min"), F.max(value_col).alias("max"), F.sum(value_col).alias("total"))
    width = F.greatest((F.col("max") - F.col("min")).cast("double"), F.lit(1e-300))
    placed = _with_labels(rows, whole, labels).withColumn("_r", F.floor((value - F.col("min")) / width * F.lit(RANGES - 1)).cast("int"))
    ranges = placed.groupBy(*labels, "_r").agg(F.count("*").alias("_c"), F.max("n").alias("_n"))
    upto = Window.partitionBy(*labels).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_upto", F.sum("_c").over(upto)).withColumn("_before", F.col("_upto") - F.col("_c"))
    index = lambda p: F.least(F.col("_n") - 1, F.floor(F.lit(p) * F.col("_n")))
    inside = lambda p: (F.col("_before") <= index(p)) & (index(p) < F.col("_upto"))
    wanted = ranges.filter(reduce(lambda x, y: x | y, [inside(p) for p in probabilities.values()])).drop("_c", "_upto")
    few = placed.join(wanted, [*labels, "_r"]).groupBy(*labels, "_r", value_col).agg(F.count("*").alias("_c"), F.max("_n").alias("_n"), F.max("_before").alias("_before"))
    within = Window.partitionBy(*labels, "_r").orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("_at", F.col("_before") + F.sum("_c").over(within)).withColumn("_low", F.col("_at") - F.col("_c"))
    quantiles = [F.min(F.when((F.col("_low") <= index(p)) & (index(p) < F.col("_at")), value)).alias(q) for q, p in probabilities.items()]
    return whole.join(few.groupBy(*labels).agg(*quantiles), labels)


def _with_labels(rows: DataFrame, whole: DataFrame, labels: list[str]) -> DataFrame:
    return rows.join(whole.select(*labels, "n", "min", "max"), labels)


def jain_fairness(amounts: DataFrame, labels: list[str], value_col: str) -> DataFrame:
    """(labels, fairness): (sum x)^2 / (n * sum x^2); 1 where all are 0."""
    x = F.col(value_col).cast("double")
    square, every = F.sum(x * x), F.sum(x)
    fairness = F.when(square == 0, 1.0).otherwise(every * every / (F.count("*") * square)).alias("fairness")
    return amounts.groupBy(*labels).agg(fairness) if labels else amounts.agg(fairness)


def increase(samples: DataFrame, labels: list[str], value_col: str, ts_col: str, seconds: int, order: str) -> DataFrame:
    """``samples`` with ``increase``: growth of a counter over the last ``seconds``, resets counted as from 0.

    The rate is the increase by ``seconds``.
    """
    series = Window.partitionBy(*labels).orderBy(ts_col, order)
    before = F.lag(value_col).over(series)
    grown = F.when(before.isNull(), 0).when(F.col(value_col) < before, F.col(value_col)).otherwise(F.col(value_col) - before)
    frame = Window.partitionBy(*labels).orderBy(F.unix_micros(F.col(ts_col).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return samples.withColumn("_grown", grown).withColumn("increase", F.sum("_grown").over(frame)).drop("_grown")


def hit_ratio(samples: DataFrame, labels: list[str], value_col: str, miss: Column) -> DataFrame:
    """(labels, ratio): the share of what isn't a miss; null where there is nothing (A10)."""
    kept = F.sum(F.when(miss, 0).otherwise(F.col(value_col)))
    return samples.groupBy(*labels).agg((kept / F.when(F.sum(value_col) > 0, F.sum(value_col))).alias("ratio"))


def histogram_quantile(samples: DataFrame, labels: list[str], value_col: str, bounds: list[float], q: float) -> DataFrame:
    """(labels, value): a quantile by linear interpolation within its bucket.

    The lowest bucket starts at 0; a rank in the last bucket gives the highest bound.
    """
    counts = [F.count_if(F.col(value_col) <= b).alias(f"_c{i}") for i, b in enumerate(bounds)]
    rows = samples.groupBy(*labels).agg(F.count("*").alias("_n"), *counts)
    rank = F.lit(q) * F.col("_n")
    value = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        low, below = (float(bounds[i - 1]), F.col(f"_c{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.lit(low) + F.lit(bounds[i] - low) * (rank - below) / F.nullif(F.col(f"_c{i}") - below, F.lit(0))
        value = F.when(F.col(f"_c{i}") >= rank, inside).otherwise(value)
    return rows.select(*labels, value.alias("value"))


def held(samples: DataFrame, labels: list[str], breach: Column, ts_col: str, seconds: int, order: str) -> DataFrame:
    """``samples`` with ``firing``: the breach has held, sample by sample, for ``seconds``."""
    series = Window.partitionBy(*labels).orderBy(ts_col, order)
    rows = samples.withColumn("_breach", breach)
    calm = F.sum(F.when(F.col("_breach"), 0).otherwise(1)).over(series)
    rows = rows.withColumn("_island", calm)
    island = Window.partitionBy(*labels, "_island")
    since = F.min(F.when(F.col("_breach"), F.unix_micros(F.col(ts_col).cast("timestamp")))).over(island)
    firing = F.col("_breach") & (F.unix_micros(F.col(ts_col).cast("timestamp")) - since >= seconds * 1_000_000)
    return rows.withColumn("firing", firing).drop("_breach", "_island")


def starvation(rounds: DataFrame, labels: list[str], order: str, dispatched: Column) -> DataFrame:
    """``rounds`` with ``skips``: consecutive rounds without a dispatch, up to this one."""
    series = Window.partitionBy(*labels).orderBy(order)
    rows = rounds.withColumn("_hit", dispatched)
    rows = rows.withColumn("_run", F.sum(F.col("_hit").cast("int")).over(series))
    within = Window.partitionBy(*labels, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("skips", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(within)).drop("_hit", "_run")


def prometheus_lines(samples: DataFrame, name: Column, labels: dict[str, Column], value: Column) -> DataFrame:
    """One text line for each sample: name, labels in braces, value."""
    inner = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in labels.items()])
    return samples.select(F.concat(name, F.lit("{"), inner, F.lit("} "), value.cast("string")).alias("line"))


def parse_prometheus(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(name, value) of text lines; the last space parts them, blank, comment and bad lines are left out."""
    text = F.trim(line_col)
    rows = lines.select(text.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    name, value = F.regexp_extract("line", r"^(.*) ([^ ]*)$", 1), F.regexp_extract("line", r"^(.*) ([^ ]*)$", 2)
    parsed = rows.select(F.trim(name).alias("name"), value.alias("_v"))
    return parsed.select("name", F.expr("try_cast(_v AS double)").alias("value")).filter("name <> '' AND value IS NOT NULL")


def with_name_prefix(metrics: DataFrame, prefix: str) -> DataFrame:
    """Metrics whose name starts with ``prefix``."""
    return metrics.filter(F.col("name").startswith(prefix))


def alerts(values: DataFrame, rules: dict[str, tuple[str, str, float]], name_col: str = "metric", value_col: str = "value") -> DataFrame:
    """``values`` by the alerts that they raise; a rule is (metric, comparison, threshold)."""
    tests = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}
    raised = [F.when((F.col(name_col) == m) & tests[op](F.col(value_col), F.lit(t)), F.lit(a)) for a, (m, op, t) in rules.items()]
    names = F.filter(F.array(*raised), lambda a: a.isNotNull())
    return values.withColumn("alert", F.explode(names))


