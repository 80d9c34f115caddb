"""The corpus pipeline: quality, near copies, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm import op1_secrets, op2_neardup, op3_decontam, op6_quality, op8_bpe
from tessera.llm._util import shared_path, table


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a text that tells its rows apart, in order of doc_id, null ids last; only rows equal in all columns share it.

    It is made of the columns alone, so it does not depend on partitions or on a second run.
    """
    every = [F.col(c) for c in docs.columns]
    mark = [c.isNull() for c in every]  # hashes leave nulls out
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(i), *every, *mark)), 16, "0") for i in range(2)]
    at = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        at = F.lpad((at.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return docs.withColumn(key, F.concat(at.isNull().cast("int").cast("string"), F.coalesce(at.cast("string"), F.lit("")), F.lit("\u0000"), *hashes))


def _free(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    name = "row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from this stage's documents and the table ``labels``.

    Each row is decided by its own text, also those with a null or repeated doc_id.
    """
    model = op6_quality.train(docs, table(spark, sf_dir, "labels"))
    key = _free(docs)
    rows = keyed(docs, key)
    keep = op6_quality.score(rows, model, id_col=key).filter("predicted = 1").select(key).distinct()
    return rows.join(keep, key, "left_semi").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest doc_id.

    Null ids come last, equal ids go by a hash of the row; different texts under one doc_id are documents of their own.
    """
    key = _free(docs)
    rows = keyed(docs, key)
    keep = op2_neardup.near_duplicates(rows, id_col=key).filter("kept").select(key)
    return rows.join(keep, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, each row by its own text."""
    key = _free(docs)
    rows = keyed(docs, key)
    found = op3_decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    drop = found.filter(F.size("hits") > 0).select(key)
    return rows.join(drop, key, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; n_chars follows."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = op1_secrets.scan(docs.select(F.struct("doc_id", *rest).alias("doc"), "text"), id_col="doc").select("doc", op1_secrets.redacted(F.col("text"), F.col("spans")).alias("text"))
    return found.select("doc.doc_id", "text", *(f"doc.{c}" for c in rest), F.length("text").cast("long").alias("n_chars")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    return op8_bpe.encode(docs, with_text=False).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs


ORACLE_SQL = None
