"""Registry of named queries, each with the DuckDB SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def fold_sql(source: str, key: str, order: str, state: dict[str, tuple[str, str]], select: str, where: str = "true") -> str:
    """Recursive SQL of an ordered fold, by one row of each key a round.

    ``source`` is a SELECT with the key and order columns; ``state`` maps each column to its
    first value and to its next one in terms of f (the state before) and s (the row). The
    output ``select`` and ``where`` see the state after a row and the row's columns.
    """
    first = ", ".join(f"{init} AS {name}" for name, (init, _) in state.items())
    following = ", ".join(f"{step} AS {name}" for name, (_, step) in state.items())
    return f"""WITH RECURSIVE src AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({source})),
    f AS (SELECT DISTINCT {key} AS fold_key, 0::BIGINT AS rn, {first} FROM src
          UNION ALL SELECT f.fold_key, s.rn, {following} FROM f JOIN src s ON s.{key} = f.fold_key AND s.rn = f.rn + 1)
    SELECT {select} FROM f JOIN src s ON s.{key} = f.fold_key AND s.rn = f.rn WHERE {where}"""
