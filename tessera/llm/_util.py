"""What several operators need: the shared folder, lineage cuts, list columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/tessera-{kind}-{uuid.uuid4().hex}"


class Stored:
    """A frame written as a table of the shared folder, and read back from it, until ``drop``.

    A checkpoint carries on its plan's size estimate, in which each join multiplies; over many rounds that number itself
    becomes too long to handle. A table's size is that of its files. For results of iterations.
    """

    def __init__(self, df: DataFrame, kind: str):
        spark = df.sparkSession
        self.at = shared_path(spark, kind)
        df.write.parquet(self.at)
        self.df = spark.read.schema(df.schema).parquet(self.at)

    def drop(self) -> None:
        """Deletes the table; what was computed from it must be written by then."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running(items: Column, start: int, step, kind: str, run: int = 128) -> Column:
    """The rows (array<kind>) that ``step(at, item)`` gives with a running ``at``: it returns the next ``at`` and an array of rows.

    An array grows by copying, so items are taken in runs whose results are put together at the end: about linear time.
    """
    none = F.array().cast(f"array<{kind}>")

    def piece(a: Column, x: Column) -> Column:
        at, rows = step(a["at"], x)
        return F.struct(at.cast("int").alias("at"), F.concat(a["out"], rows).alias("out"))

    def extend(a: Column, r: Column) -> Column:
        return F.concat(a, F.array(F.aggregate(r, F.struct(F.get(a, F.size(a) - 1)["at"].alias("at"), none.alias("out")), piece)))

    def whole(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(run)), lambda i: F.slice(x, i + 1, F.lit(run)))
        return F.flatten(F.transform(F.aggregate(runs, F.array(F.struct(F.lit(start).alias("at"), none.alias("out"))), extend), lambda a: a["out"]))

    return F.get(F.transform(F.array(items), whole), F.lit(0))  # items are computed once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
