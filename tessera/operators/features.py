"""Pair features over a candidate pool: sets, relations, windows and string similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import strsim
from .blocking import number_relation

# fixed values
REL_CODES = {"equal": 0, "subset": 1, "trunc": 2, "overlap": 3, "missing": 4, "disjoint": 5}


def sided(pairs: DataFrame, s: DataFrame, r: DataFrame) -> DataFrame:
    """Pairs with the token columns of both sides, as ``X_s`` and ``X_r``."""
    cols = ["nw", "core", "alias", "legal", "decoy", "sk", "aw", "ad", "au", "stw", "noaddr"]
    left = s.select(F.col("entity_id").alias("s1"), *(F.col(c).alias(f"{c}_s") for c in cols))
    right = r.select(F.col("entity_id").alias("r"), *(F.col(c).alias(f"{c}_r") for c in cols))
    return pairs.join(left, "s1").join(right, "r")


def _both(x: str) -> Column:
    return F.size(F.array_intersect(f"{x}_s", f"{x}_r")).cast("long")


def _only(x: str, a: str, b: str) -> Column:
    return F.size(F.array_except(f"{x}_{a}", f"{x}_{b}")).cast("long")


def overlap(x: str) -> Column:
    """Common elements over the larger side's size."""
    a, b = (F.size(F.array_distinct(f"{x}_{k}")) for k in "sr")
    return F.round(_both(x) / F.greatest(a, b, F.lit(1)), 6)


def house_relation(a: Column, b: Column) -> Column:
    """0 equal, 1 one is cut from the other, 2 at most 25 apart, 3 one edit, 4 other, 5 missing."""
    longer = F.abs(F.length(a) - F.length(b)) == 1
    cut = longer & (a.startswith(b) | a.endswith(b) | b.startswith(a) | b.endswith(a))
    gap = F.abs(F.expr("1") * (a.try_cast("decimal(38,0)") - b.try_cast("decimal(38,0)")))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 5).when(a == b, 0).when(cut, 1).when(gap <= 25, 2).when(F.levenshtein(a, b) == 1, 3).otherwise(4)


def share_code(x: str) -> Column:
    """2 missing on a side, 0 something in common, 1 conflict."""
    return F.when((F.size(f"{x}_s") == 0) | (F.size(f"{x}_r") == 0), 2).when(_both(x) > 0, 0).otherwise(1)


def set_features(d: DataFrame) -> DataFrame:
    rel = number_relation(F.col("ad_s"), F.col("ad_r"))
    codes = F.create_map(*(F.lit(x) for kv in REL_CODES.items() for x in kv))
    return d.select(
        "*",
        F.size("core_s").cast("long").alias("n_core_s"), F.size("core_r").cast("long").alias("n_core_r"),
        F.size("ad_s").cast("long").alias("n_num_s"), F.size("ad_r").cast("long").alias("n_num_r"),
        F.abs(F.length(F.array_join("nw_s", " ")) - F.length(F.array_join("nw_r", " "))).cast("long").alias("len_diff"),
        F.col("r").startswith("S3").alias("src_s3"),
        _both("core").alias("n_core_common"), _only("core", "r", "s").alias("n_extra_r"), _only("core", "s", "r").alias("n_missing_r"),
        _only("sk", "r", "s").alias("n_extra_sk"), _only("sk", "s", "r").alias("n_missing_sk"),
        F.size(F.array_intersect("decoy_r", F.array_except("nw_r", "nw_s"))).cast("long").alias("n_decoy_extra"),
        overlap("sk").alias("sk_jacc"), overlap("nw").alias("nw_jacc"), overlap("aw").alias("aw_jacc"), overlap("ad").alias("num_jacc"),
        share_code("legal").cast("int").alias("legal_rel"), share_code("au").cast("int").alias("unit_rel"),
        house_relation(F.get("ad_s", F.lit(0)), F.get("ad_r", F.lit(0))).cast("int").alias("house_rel"),
        F.element_at(codes, rel).cast("int").alias("num_rel"),
    )


def string_features(d: DataFrame) -> DataFrame:
    """All similarities of a pair in one trip to Python."""
    j = lambda c: F.array_join(c, " ")
    bag = lambda c: F.array_join(F.array_sort(F.split(F.array_join(c, ""), "")), "")
    d = d.withColumn("sim", strsim.name_similarities(j("nw_s"), j("nw_r"), j("core_s"), j("core_r")))
    d = d.select("*", "sim.*").drop("sim")
    st = F.when((F.size("stw_s") == 0) | (F.size("stw_r") == 0), F.lit(-1.0)).otherwise(strsim.token_set_udf(j("stw_s"), j("stw_r")))
    return d.select(
        "*", strsim.token_set_udf(j("core_s"), j("core_r")).alias("co_tset"), strsim.token_set_udf(j("core_s"), j("alias_r")).alias("co_alias_tset"),
        strsim.token_set_udf(j("aw_s"), j("aw_r")).alias("ad_tset"), strsim.ratio_udf(bag("core_s"), bag("core_r")).alias("bag_ratio"), st.alias("st_sim"),
    )


def context_features(d: DataFrame) -> DataFrame:
    """sc_ratio, sc_rank and n_cands in the query's list; needs complete lists."""
    own = W.Window.partitionBy("s1")
    top = F.max("sc").over(own)
    return d.select(
        "*", F.round(F.coalesce(F.try_divide("sc", top), F.lit(0.0)), 6).alias("sc_ratio"),
        F.row_number().over(own.orderBy(F.col("sc").desc(), "r")).alias("sc_rank"), F.count("*").over(own).alias("n_cands"),
    )


def group_features(d: DataFrame) -> DataFrame:
    """Size, equal house numbers and mean name score of a query's signature groups (a null ``gid`` is a group of its own)."""
    own = W.Window.partitionBy("s1", F.coalesce("gid", F.concat(F.lit("r:"), F.col("r"))))
    return d.select(
        "*", F.count("*").over(own).alias("grp_size"), F.sum((F.col("house_rel") == 0).cast("int")).over(own).alias("grp_house_eq"),
        F.round(F.avg("nm_tset").over(own), 6).alias("grp_nm_tset_mean"),
    )


#: columns that name a pair or explain it, and so are no inputs of a model
NO_FEATURES = {"s1", "r", "y", "country", "gid", "rel", "sig", "p", "q", "fold"}


def feature_columns(d: DataFrame) -> list[str]:
    """Names of the numeric and boolean columns that are inputs of the models, in order."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return [c for c, kind in d.dtypes if c not in NO_FEATURES and (kind in kinds or kind.startswith("decimal"))]


def passed_through(d: DataFrame, pool: DataFrame) -> DataFrame:
    """``d`` with the pool's own columns (score, ranks, arms, expansion, margins); those of the embedding arm are null without it."""
    for c, kind in (("erk", "int"), ("esim", "double")):
        if c not in pool.columns:
            pool = pool.withColumn(c, F.lit(None).cast(kind))
    arms = [c for c in pool.columns if c[0] == "a" and c[1:].isdigit()]
    keep = [c for c in ("sc", "prk", "xrk", *arms, "exp", "rev_margin", "erk", "esim") if c in pool.columns and c not in d.columns]
    return d.join(pool.select("s1", "r", *keep), ["s1", "r"], "left")


def claim_features(d: DataFrame, share: float = 0.95) -> DataFrame:
    """n_claimants: queries that found the record; n_claim: those whose score is at least ``share`` of its best."""
    own = W.Window.partitionBy("r")
    best = F.max("sc").over(own)
    return d.withColumn("best", best).select(d["*"], F.count("*").over(own).alias("n_claimants"), F.sum((F.col("sc") >= F.lit(share) * F.col("best")).cast("int")).over(own).alias("n_claim"))


def name_frequency(records: DataFrame) -> DataFrame:
    key = F.array_join(F.array_sort("core"), " ")
    return records.select("entity_id", F.count("*").over(W.Window.partitionBy("country", key)).alias("s1_name_freq"))


# fixed values: the ordered rules of the cut-off
CUT_RULES = (
    "house_rel = 0 and sk_jacc >= .5",
    "sc_rank <= 1",
    "nm_tset >= 90 and ad_tset >= 60",
    "nm_tset >= 90 and noaddr_r",
    "sc_rank <= 3",
    "nm_tset >= 80 and noaddr_r",
    "nm_tset >= 80 and ad_tset >= 60",
    "sc_rank <= 5",
    "nm_tset >= 70 and noaddr_r",
    "num_rel = 0",
    "nm_tset >= 70 and ad_tset >= 60",
    "num_rel in (0, 1, 2) and sk_jacc >= .5",
    "house_rel = 0",
    "num_rel in (0, 1, 2)",
)


def cutoff_mask(n: int, embedding: bool = True) -> Column:
    """True where any of the first n rules holds, or the pair is an embedding neighbour; null counts as false."""
    rules = [*CUT_RULES[:n], *(["erk <= 20"] if embedding else [])]
    out = F.lit(False)
    for r in rules:
        out = out | F.coalesce(F.expr(r), F.lit(False))
    return out
