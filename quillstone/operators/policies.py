"""Pluggable retention policies, by kind of state (X1), and table providers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Rule = Callable[[dict[str, Column]], Column]
Provider = Callable[[SparkSession], DataFrame]


class PolicyRegistry:
    """Column-building policies: each kind's rules see the columns and return should_store, eviction and on_miss."""

    def __init__(self) -> None:
        self._rules: dict[str, tuple[Rule, Rule, Rule]] = {}

    def register(self, kind: str, should_store: Rule, eviction: Rule, on_miss: Rule) -> None:
        self._rules[kind] = (should_store, eviction, on_miss)

    def _choose(self, part: int, kind: Column, columns: dict[str, Column], default: Column) -> Column:
        return reduce(lambda e, k: F.when(kind == k, self._rules[k][part](columns)).otherwise(e), self._rules, default)

    def apply(self, rows: DataFrame, kind_col: str) -> DataFrame:
        """``rows`` with store, eviction and on_miss; kinds without a policy store, evict and recompute."""
        columns = {c: F.col(c) for c in rows.columns}
        kind = F.col(kind_col)
        return rows.select(
            "*",
            self._choose(0, kind, columns, F.lit(True)).alias("store"),
            self._choose(1, kind, columns, F.lit("evict")).alias("eviction"),
            self._choose(2, kind, columns, F.lit("recompute")).alias("on_miss"),
        )
