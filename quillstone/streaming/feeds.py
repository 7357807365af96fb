"""Structured Streaming forms: event feeds, replication, publication and admission.

The batch operators' expressions are used as they are; what differs is where state lives.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators.fold import Fold
from quillstone.operators.ledger import is_warm
from quillstone.operators.qos import ADMIT_FIELDS, admit_fold
from quillstone.operators.sketch import bits
from quillstone.session import ensure_checkpoint_dir


def events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder's Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def project(feed: DataFrame) -> DataFrame:
    """What the wire form of a feed carries: type and epoch."""
    return feed.select("type", "epoch")


def run_to_end(stream: DataFrame, mode: str = "append", schema: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, into a table in the shared folder, and returns the table."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(f"{folder}/rows").awaitTermination()
    else:

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/rows")

        writer.outputMode(mode).foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def replicate(feed: DataFrame, primary: DataFrame, path: str, max_tier: int = 1, key: str = "key") -> Callable[[], None]:
    """Starts the copying of a feed's new warm additions to ``path``; returns a wait-till-done.

    Each batch keeps what is warm and above the stream's cursor, fetches its payload from
    ``primary`` and writes it under the batch's number, so that a repeated batch replaces its
    own rows. The cursor is the highest epoch written or passed over; an event whose payload is
    gone moves it too.
    """
    spark = feed.sparkSession
    state = f"{path}-cursor"

    def copy(batch: DataFrame, number: int) -> None:
        cursors = "stream string, epoch bigint"
        try:  # each batch writes the cursors of all streams, so the last batch's are enough
            seen = spark.read.schema(cursors).parquet(f"{state}/batch={number - 1}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = spark.createDataFrame([], cursors)
        warm = batch.filter(is_warm(F.col("type"), F.col("tier"), max_tier)).join(seen.withColumnRenamed("epoch", "cursor"), "stream", "left")
        fresh = warm.filter(F.col("epoch") > F.coalesce("cursor", F.lit(0))).drop("cursor").dropDuplicates(["stream", "epoch"]).persist()
        fresh.join(primary, key).write.mode("overwrite").parquet(f"{path}/batch={number}")
        moved = fresh.select("stream", "epoch").unionByName(seen).groupBy("stream").agg(F.max("epoch").alias("epoch"))
        moved.write.mode("overwrite").parquet(f"{state}/batch={number}")
        fresh.unpersist()

    query = feed.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(copy).start()
    return query.awaitTermination


def published_sketches(feed: DataFrame, ts: str, key: Column, m: int, k: int, every: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """(start, bit) of each window of a stream, once it is over."""
    timed = feed.withWatermark(ts, late).select(F.window(ts, every).alias("w"), F.explode(bits(key, m, k)).alias("bit"))
    return timed.groupBy("w", "bit").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "bit")


def debounced(feed: DataFrame, keys: list[str], ts: str, gap: str, late: str = "1 minute") -> DataFrame:
    """(keys, start, end, changes): one row for each burst of a stream, once it is over."""
    grouped = feed.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count("*").alias("changes")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def folded(feed: DataFrame, fold: Fold) -> DataFrame:
    """An ordered fold over a stream: a key's state is kept in the state store between batches.

    Rows are ordered within a batch; order across batches is that of arrival.
    """
    names = [x.name for x in T._parse_datatype_string(fold.schema)]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else fold.start()
        out: list[tuple] = []
        for r in pd.concat(list(parts)).sort_values(fold.order).to_dict("records"):
            out += fold.step(held, {k: None if v is None or v is pd.NaT or v != v else v for k, v in r.items()})
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=names)

    return feed.groupBy(*fold.keys).applyInPandasWithState(step, fold.schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def admitted(requests: DataFrame, limits: DataFrame, window_ms: int = 1000) -> DataFrame:
    """qos.admit() of a stream."""
    rows = requests.join(limits, "tenant", "left").select(*ADMIT_FIELDS)
    return folded(rows, admit_fold(requests.schema["tenant"].dataType.simpleString(), window_ms))


def on_event(feed: DataFrame, callback: Callable[[DataFrame, int], Any], checkpoint: str) -> Callable[[], None]:
    """Calls ``callback`` with each batch of events and its number."""
    query = feed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(callback).start()
    return query.awaitTermination
