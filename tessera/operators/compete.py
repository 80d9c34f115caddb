"""Features of the competition for records, and of a query's confident siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import strsim
from .decide import odds


def competition(d: DataFrame) -> DataFrame:
    r, s = W.Window.partitionBy("r"), W.Window.partitionBy("s1")
    o = F.round(odds(F.col("p")), 9)
    d = d.withColumn("o", o)
    total = F.sum("o").over(r)
    return d.select(
        "s1", "r", "p", F.count("*").over(r).alias("n_r"), F.row_number().over(r.orderBy(F.col("p").desc(), "s1")).alias("rk_r"),
        F.row_number().over(s.orderBy(F.col("p").desc(), "r")).alias("rk_s"), F.count("*").over(s).alias("n_s"), F.max("p").over(s).alias("pmax_s"),
        F.round(F.sum("p").over(s), 6).alias("psum_s"), F.round(F.try_divide(F.col("o"), total), 6).alias("share_r"),
        F.round(total - F.col("o"), 4).alias("so_other_r"), F.round(F.col("o") / (F.lit(0.5) + total), 6).alias("q05"),
    )


def siblings(d: DataFrame, texts: DataFrame, sure: float = 0.5) -> DataFrame:
    """Best address and name ratio with the query's confident candidates of the same source; -1 without any.

    texts: (r, addr, name). One self-join on (query, source), sure rows on one side; sources cap a query's true matches.
    """
    own = d.join(texts, "r").withColumn("src", F.substring("r", 1, 2))
    anchor = own.filter(F.col("p") > sure).select("s1", "src", F.col("r").alias("r2"), F.col("addr").alias("addr2"), F.col("name").alias("name2"))
    both = own.join(anchor, ["s1", "src"]).filter("r <> r2")
    best = both.select("s1", "r", strsim.ratio_udf("addr", "addr2").alias("a"), strsim.ratio_udf("name", "name2").alias("n"), (F.col("addr") == F.col("addr2")).alias("e"))
    best = best.groupBy("s1", "r").agg(F.max("a").alias("sib_addr"), F.max("n").alias("sib_name"), F.bool_or("e").alias("sib_exact"), F.count("*").alias("n_sib"))
    minus = F.lit(-1.0)
    return d.join(best, ["s1", "r"], "left").select(d["*"], F.coalesce("sib_addr", minus).alias("sib_addr"), F.coalesce("sib_name", minus).alias("sib_name"), F.coalesce("sib_exact", F.lit(False)).alias("sib_exact"), F.coalesce("n_sib", F.lit(0)).alias("n_sib"))
