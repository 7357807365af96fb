"""Where a router and a replica get their tables from (X3, X7): functions that return DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import routing

Provider = Callable[[], DataFrame]


@dataclass(frozen=True)
class Router:
    """Routes requests by its providers' tables, read anew at each call.

    ``nodes`` gives id and weight; ``cache`` key, ts and node; ``known`` the keys that the
    sketch may have, or None where there is no sketch and all may be there.
    """

    nodes: Provider
    cache: Provider
    known: Provider | None = None
    ttl_seconds: int = 30

    def read(self, requests: DataFrame, key_col: str, ts_col: str) -> DataFrame:
        """``requests`` with source and node."""
        rows = routing.route_cache(requests, self.cache(), key_col, ts_col, self.ttl_seconds)
        rows = routing.hrw_primary(rows, F.col(key_col).cast("string"), routing.node_array(self.nodes(), "id", "weight")).withColumnRenamed("node", "_hrw")
        maybe: Column = F.lit(True)
        if self.known:
            rows = rows.join(self.known().select(key_col).distinct().withColumn("_known", F.lit(True)), key_col, "left")
            maybe = F.col("_known").isNotNull()
        return routing.read_route(rows, maybe, F.col("cached"), F.col("_hrw")).drop("cached", "_hrw", "_known")


def fetch_replicas(locators: DataFrame, key: str, *sources: Provider) -> DataFrame:
    """``locators`` with the payload of the first source that has the key; those that none has are left out."""
    rows = locators
    for i, source in enumerate(sources):
        rows = rows.join(source().select(key, F.col("payload").alias(f"_p{i}")), key, "left")
    names = [f"_p{i}" for i in range(len(sources))]
    return rows.withColumn("payload", F.coalesce(*names)).drop(*names).filter("payload IS NOT NULL")
