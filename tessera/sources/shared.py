"""The folder that driver and executors share, and cuts of lineage in it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one under /tmp/checkpoints where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written once as a table of the shared folder and read back; columns that are not asked for are not read. It stays for whoever reads the result."""
    at = f"{shared_dir(df.sparkSession)}/tessera-{kind}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
