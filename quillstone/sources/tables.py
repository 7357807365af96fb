"""Where state is read from and written to: tables, blobs, logs and metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.tiers import cold_path


def cold_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, content) of a folder or glob of objects (S16); content is read only if selected."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def object_uri(bucket: str, key: Column, scheme: str = "s3a") -> Column:
    """The Hadoop URI of a cold object (S17); signing and retries are the connector's."""
    return F.concat(F.lit(f"{scheme}://{bucket}/"), cold_path(key))


def put_blobs(blobs: DataFrame, path: str, key: str, value: str) -> None:
    """Appends (key, value) blobs to a table partitioned by the key's first two digits."""
    blobs.select(F.substring(key, 1, 2).alias("shard"), key, value).write.mode("append").partitionBy("shard").parquet(path)


def get_blobs(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """Blobs of the wanted keys; the shard column prunes the scan by the keys' own shards."""
    wanted = keys.select(key, F.substring(key, 1, 2).alias("shard")).distinct()
    return spark.read.parquet(path).join(wanted, ["shard", key], "left_semi").drop("shard")


def metrics_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of metrics text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def append_audit(lines: DataFrame, path: str) -> None:
    """Appends audit lines as text."""
    lines.select("line").write.mode("append").text(path)


def registry_snapshot(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(key, value, revision) of JSON lines under a prefix, last revision of each key."""
    rows = spark.read.schema("key string, value string, revision bigint").json(path).filter(F.startswith("key", F.lit(prefix)))
    return rows.groupBy("key").agg(F.max_by("value", "revision").alias("value"), F.max("revision").alias("revision"))
