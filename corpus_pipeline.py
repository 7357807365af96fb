"""Training-corpus pipeline over ``documents``: five stages, each by one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of ``documents``; other
columns of ``docs`` are left out. A null text counts as empty and fails the quality rules; null
languages and sources are groups of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.binding import once
from quillstone.llm import langid, nearcopy, packing, quality, secrets
from quillstone.llm.queries import END_ID, tokenizer_path
from quillstone.session import ensure_checkpoint_dir, read_table, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A document is rejected whose best language stands out from chance by less than this share of the way to certainty.
LEAST_ABOVE_CHANCE = 0.1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are outliers of their language and source; see ``quality.judge``."""
    small_batches(spark)
    return quality.judge(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a clear language; a missing ``lang`` is filled with the prediction.

    With k languages chance alone scores 1/k, so the threshold lies above that. Where no row has
    a language to learn from, every document stays. Null texts have none and go; null ids,
    repeated rows and ties of the score are no matter.
    """
    small_batches(spark)
    model = langid.train(docs, "text", "lang")
    if model is None:
        return docs.select(COLUMNS)
    chance = 1 / len(model.languages)
    seen = docs.select(*COLUMNS, once(langid.predict(F.col("text"), model)).alias("p"))
    clear = (F.col("p.lang") != langid.UNDETERMINED) & (F.col("p.score") >= chance + LEAST_ABOVE_CHANCE * (1 - chance))
    return seen.filter(clear).select("doc_id", "text", F.coalesce("lang", "p.lang").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of smallest id, of each group of near copies.

    Candidates come from SimHash segments and their one-wildcard variants; near copies have 0.8
    or more of their five-word shingles in common (Jaccard). Different texts of one id are
    documents of their own; of equal rows one stays.
    """
    small_batches(spark)
    return nearcopy.representatives(docs.select(COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark; every document stays, those of null id or text and repeated rows too."""
    small_batches(spark)
    return docs.withColumn("text", secrets.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; the result has a row for each piece, with its ids.

    Documents of null id or text are packed like others, and repeated rows each.
    """
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Outliers, the language network and the packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
