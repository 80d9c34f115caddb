"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Documents of equal text form a group. Groups lighter than ``1 / heavy`` of a shard in every dimension are bundled by
a hash of their text into a fixed number of bundles, heavier ones stand alone, and one that is heavier than
``1 / split`` of a shard is divided by a hash of the row into pieces. So the number of items to pack is bounded by
``bundles + 3 * shards * heavy + pieces`` whatever the input, and each row finds its item from its own columns and the
bounded list of heavy groups. Items are placed in order of falling weight where the dot product of their
vector with the shard's residual capacity is highest.

Slots are numbered without a sort per shard: rows are counted by (shard, slice of the id hash), the counts become
offsets, and rows are ranked within a slice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._util import cut, table

NAME = "op10_shards"


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of non-negative weights): heaviest first, to the highest dot product with what is left."""
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1) * shards
    left, out = np.ones((shards, items.shape[1])), np.zeros(len(items), dtype=np.int32)
    for i in np.lexsort((np.arange(len(items)), -share.sum(axis=1), -share.max(axis=1))):
        k = int(np.argmax(left @ share[i]))
        out[i] = k
        left[k] -= share[i]
    return out


def assign(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", bundles: int = 256, heavy: int = 128, split: int = 8, slices: int = 1024) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; law ``bytes``.

    size: UTF-8 bytes of the text plus 8 (null: none). ``bundles`` is a number per shard. Rows are equal citizens: repeated
    rows get slots of their own, a null id counts as an id, an empty table gives no rows. Shards and slots depend on the rows alone, not on
    partitions or settings (``slices`` of a shard are numbered apart). A group stays in
    one shard unless it holds over 1/``split`` of a shard's capacity. Columns other than the two named are not read.
    """
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("g1"),
        F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("g2"),
        F.xxhash64(F.col(id_col), F.coalesce(text, F.lit(""))).alias("hid"),
    )
    rows = cut(rows)
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    b, t, r = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    if not r:
        total = [1, 1, 1]
    else:
        total = [max(1, x or 0) / shards for x in (b, t, r)]
    part = F.greatest(*(F.col(c) / F.lit(float(x)) for c, x in zip("btr", total)))
    # at most 3 * shards * heavy rows: each holds 1/heavy of a shard in one of three dimensions
    big = groups.withColumn("part", part).filter(F.col("part") >= 1.0 / heavy).select("g1", "g2", F.greatest(F.ceil(F.col("part") * split), F.lit(1)).cast("int").alias("pieces"))
    items = rows.join(F.broadcast(big), ["g1", "g2"], "left").select(
        "*",
        F.when(F.col("pieces").isNotNull(), F.col("g1")).otherwise(F.pmod("g1", F.lit(bundles * shards))).alias("k1"),
        F.when(F.col("pieces").isNotNull(), F.col("g2")).otherwise(F.lit(0)).alias("k2"),
        F.when(F.col("pieces").isNotNull(), F.pmod("hid", "pieces").cast("int")).otherwise(F.lit(-1)).alias("piece"),
    )
    sums = items.groupBy("k1", "k2", "piece").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).orderBy("k1", "k2", "piece").collect()
    place = pack(np.array([[x.b, x.t, x.r] for x in sums], dtype=float).reshape(-1, 3), shards)
    spark = df.sparkSession
    plan = spark.createDataFrame([(x.k1, x.k2, x.piece, int(s)) for x, s in zip(sums, place)], "k1 long, k2 long, piece int, shard int")
    placed = items.join(F.broadcast(plan), ["k1", "k2", "piece"]).withColumn("slice", F.pmod("hid", F.lit(slices)))
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = W.Window.partitionBy("shard").orderBy("slice").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.Window.partitionBy("shard", "slice").orderBy("id", "text_crc32", "size"))
    ranked = placed.select("id", "size", "text_crc32", "shard", "slice", (rank - 1).cast("long").alias("at"))
    return ranked.join(offsets, ["shard", "slice"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") + F.col("offset")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
