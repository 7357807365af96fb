"""Ordered folds: state that depends on the exact order of a key's rows.

Rows are brought together by key and sorted within each partition by Spark, which spills, and a
partition is read as a stream of Arrow batches. Only one key's state is held at a time, so
neither a key with many rows nor a partition with many keys has to fit memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

BATCH = 4096


@dataclass(frozen=True)
class Fold:
    """What a fold does, for batches (ordered_fold) and streams (streaming.feeds.folded) alike."""

    keys: list[str]
    order: list[str]
    start: Callable[[], Any]
    step: Callable[[Any, dict], Iterable[tuple]]
    schema: str

    def over(self, rows: DataFrame) -> DataFrame:
        return ordered_fold(rows, self.keys, self.order, self.start, self.step, self.schema)


def ordered_fold(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], Any],
    step: Callable[[Any, dict], Iterable[tuple]],
    schema: str,
    finish: Callable[[Any, dict], Iterable[tuple]] | None = None,
) -> DataFrame:
    """Rows that ``step`` yields from each key's rows in order, and ``finish`` at each key's end.

    ``step`` gets the key's state and the row, and may change the state; ``finish`` gets the
    state and the key's last row. Ties of ``order`` should be broken by the caller's columns.
    """
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    names = struct.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, state, last = None, None, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], names)

        for part in batches:
            for row in part.to_pylist():
                now = tuple(row[k] for k in keys)
                if now != key or last is None:
                    if last is not None and finish:
                        out += finish(state, last)
                    key, state = now, start()
                out += step(state, row)
                last = row
                if len(out) >= BATCH:
                    yield batch()
                    out.clear()
        if last is not None and finish:
            out += finish(state, last)
        if out:
            yield batch()

    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
