"""From scored pairs (s1, r, p) to a match set: thresholds, expected F, caps, one owner."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import strsim

# fixed values: matches of a query per source and in all
SOURCE_CAPS, TOTAL_CAP = {"S2": 5, "S3": 6}, 11


def odds(p: Column) -> Column:
    q = F.least(p, F.lit(1 - 1e-6))
    return q / (1 - q)


def exclusive_posterior(d: DataFrame, k: float = 1.0) -> DataFrame:
    """Adds q: odds over k plus the sum of odds of all queries for the record."""
    return d.withColumn("q", odds(F.col("p")) / (F.lit(k) + F.sum(odds(F.col("p"))).over(W.Window.partitionBy("r"))))


def ranked(d: DataFrame) -> DataFrame:
    return d.withColumn("rk", F.row_number().over(W.Window.partitionBy("s1").orderBy(F.col("p").desc(), "r")))


def rank_threshold(d: DataFrame, t1, t2) -> DataFrame:
    """First rank needs p > t1, others p > t2; thresholds are numbers or columns (a threshold per country)."""
    t1, t2 = (t if isinstance(t, Column) else F.lit(t) for t in (t1, t2))
    return ranked(d).filter(F.col("p") > F.when(F.col("rk") == 1, t1).otherwise(t2)).drop("rk")


def conditioned_top1(d: DataFrame, t1: float, low: float, margin: float, t2: float) -> DataFrame:
    """As ``rank_threshold``, with the lower first threshold where the record has no better query."""
    return rank_threshold(d, F.when(F.col("rev_margin") > -margin, F.lit(low)).otherwise(F.lit(t1)), t2)


def source_caps(d: DataFrame) -> DataFrame:
    order = (F.col("p").desc(), "r")
    src = F.substring("r", 1, 2)
    d = d.withColumn("k", F.row_number().over(W.Window.partitionBy("s1", src).orderBy(*order)))
    cap = F.when(src == "S2", SOURCE_CAPS["S2"]).otherwise(SOURCE_CAPS["S3"])
    d = d.filter(F.col("k") <= cap).withColumn("k", F.row_number().over(W.Window.partitionBy("s1").orderBy(*order)))
    return d.filter(F.col("k") <= TOTAL_CAP).drop("k")


def one_owner(d: DataFrame) -> DataFrame:
    """Each record to the query with the highest p, ties to the smallest id."""
    best = F.row_number().over(W.Window.partitionBy("r").orderBy(F.col("p").desc(), "s1"))
    return d.withColumn("k", best).filter("k = 1").drop("k")


def expected_f(p: np.ndarray, h: np.ndarray | None = None, beta: float = 0.5) -> np.ndarray:
    """rows x (m + 1): expected F of keeping the first k pairs of independent labels p (falling, 0-padded).

    F is a sum over the kept pairs that are true, so its expectation is the sum over them of p times the expected gain, where
    the gain depends on how many of the other pairs are true: for each pair the distribution of that number.
    ``h`` is the probability that the query has a match at all, which rescales everything but the empty decision.
    """
    rows, m = p.shape
    b2 = beta * beta
    others = np.zeros((m, rows, m))
    others[:, :, 0] = 1
    for j in range(m):
        grown = others * (1 - p[:, j, None])
        grown[:, :, 1:] += others[:, :, :-1] * p[:, j, None]
        grown[j] = others[j]
        others = grown
    k, t = np.arange(1, m + 1)[:, None], np.arange(m)[None, :]
    each = np.einsum("irt,kt->rki", others, (1 + b2) / (b2 * (1 + t) + k)) * p[:, None, :]
    none = np.prod(1 - p, axis=1)
    out = np.column_stack((none, (each * (np.arange(m)[None, :] < k)).sum(axis=2)))
    if h is not None:
        out[:, 1:] *= (h / np.maximum(1 - none, 1e-9))[:, None]
        out[:, 0] = 1 - h
    return out


def expected_f_decode(d: DataFrame, gamma: float = 1.0, width: int = 15, beta: float = 0.5, has: DataFrame | None = None) -> DataFrame:
    """Per query the best pairs whose number has the highest expected F; lists of p in, one number out per query.

    has: (s1, h), the probability of any match; a query that it leaves out has one.
    """
    kind = d.schema["s1"].dataType.simpleString()
    head = has is not None

    def best(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), width))
            for i, x in enumerate(pdf["ps"]):
                m[i, : min(width, len(x))] = np.asarray(x[:width], dtype=float) ** gamma
            h = pdf["h"].to_numpy(dtype=float) if head else None
            yield pd.DataFrame({"s1": pdf["s1"], "keep": expected_f(m, h, beta).argmax(axis=1)})

    lists = d.groupBy("s1").agg(F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, width).alias("ps"))
    if head:
        lists = lists.join(has.select("s1", "h"), "s1", "left").fillna(1.0, ["h"])
    return ranked(d).join(lists.mapInPandas(best, f"s1 {kind}, keep long"), "s1").filter("rk <= keep").drop("rk", "keep")


def decide(d: DataFrame, cfg: dict, has: DataFrame | None = None) -> DataFrame:
    """Rule of a decision config, then the source caps; rule ``head`` needs ``has`` (s1, h), the model's probability of any match."""
    rule, gamma = cfg["rule"], cfg.get("gamma", 1.0)
    if rule == "rank":
        out = rank_threshold(d, cfg["t1"], cfg["t2"])
    elif rule == "expected":
        out = expected_f_decode(d, gamma)
    elif rule == "exclusive":
        out = expected_f_decode(exclusive_posterior(d).withColumn("p", F.col("q")).drop("q"), gamma)
    elif rule == "head":
        if has is None:
            raise ValueError("the rule needs the probabilities of any match")
        out = expected_f_decode(d, gamma, has=has)
    else:
        raise ValueError(rule)
    return source_caps(out)


def redecided(old: DataFrame, d: DataFrame, decided: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Pairs of ``decided`` for queries with any p inside (low, high), the pairs of ``old`` for all others; nothing is scored anew."""
    unsure = d.filter((F.col("p") > low) & (F.col("p") < high)).select("s1").distinct()
    return old.select("s1", "r").join(unsure, "s1", "left_anti").unionByName(decided.select("s1", "r").join(unsure, "s1", "left_semi"))


def street_filter(d: DataFrame, words_s: DataFrame, words_r: DataFrame, least: float = 50.0) -> DataFrame:
    """Drops pairs whose street words exist on both sides and have no pair of words alike by ``least``."""
    both = d.join(words_s.select(F.col("entity_id").alias("s1"), F.col("stw").alias("a")), "s1").join(words_r.select(F.col("entity_id").alias("r"), F.col("stw").alias("b")), "r")
    words = both.filter((F.size("a") > 0) & (F.size("b") > 0)).select("s1", "r", F.explode("a").alias("a"), "b").select("s1", "r", "a", F.explode("b").alias("b"))
    bad = words.withColumn("x", strsim.ratio_udf("a", "b")).groupBy("s1", "r").agg(F.max("x").alias("x")).filter(F.col("x") < least)
    return d.join(bad.select("s1", "r"), ["s1", "r"], "left_anti")


def closure(d: DataFrame, s1: DataFrame) -> DataFrame:
    """The given queries and all that share a candidate record with them."""
    return d.join(d.join(s1, "s1", "left_semi").select("r").distinct(), "r", "left_semi").select("s1").distinct()


def tune(d: DataFrame, truth: DataFrame, queries: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """(t1, t2, f): macro F0.5 of every point of a small grid in one pass."""
    from .metrics import f_beta

    points = d.sparkSession.createDataFrame(grid, "t1 double, t2 double")
    lab = ranked(d).join(truth.withColumn("y", F.lit(1)), ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    kept = lab.join(F.broadcast(points), F.col("p") > F.when(F.col("rk") == 1, F.col("t1")).otherwise(F.col("t2")))
    got = kept.groupBy("t1", "t2", "s1").agg(F.count("*").alias("np"), F.sum("y").alias("tp"))
    nt = queries.join(truth.groupBy("s1").agg(F.count("*").alias("nt")), "s1", "left").select("s1", F.coalesce("nt", F.lit(0)).alias("nt"))
    empty = nt.agg(F.count("*").alias("n"), F.sum((F.col("nt") == 0).cast("int")).alias("zero"))
    f = got.join(nt, "s1").groupBy("t1", "t2").agg(F.sum(f_beta(F.col("tp"), F.col("np"), F.col("nt"))).alias("f"), F.sum((F.col("nt") == 0).cast("int")).alias("wrong"))
    return points.join(f, ["t1", "t2"], "left").join(F.broadcast(empty)).select("t1", "t2", ((F.coalesce("f", F.lit(0.0)) + F.col("zero") - F.coalesce("wrong", F.lit(0))) / F.col("n")).alias("f"))


def tune_refined(d: DataFrame, truth: DataFrame, queries: DataFrame, step: float = 0.1, fine: float = 0.05) -> tuple[float, float, float]:
    """(t1, t2, f) of the best point of a grid over (0, 1), then of the finer points around it; ties go to the smaller thresholds."""

    def best(grid):
        x = tune(d, truth, queries, sorted(set(grid))).orderBy(F.round("f", 9).desc(), "t1", "t2").first()
        return x.t1, x.t2, x.f

    n = round(1 / step)
    t1, t2, _ = best([(round(a * step, 6), round(b * step, 6)) for a in range(1, n) for b in range(1, n)])
    return best([(round(t1 + a * fine, 6), round(t2 + b * fine, 6)) for a in (-1, 0, 1) for b in (-1, 0, 1)])


def tune_by(d: DataFrame, truth: DataFrame, queries: DataFrame, by: str, grid: list[tuple[float, float]]) -> DataFrame:
    """(by, t1, t2, f): the best point of each group of queries (s1, by); the mean over queries parts by group, so each is on its own."""
    from .metrics import f_beta

    points = d.sparkSession.createDataFrame(grid, "t1 double, t2 double")
    lab = ranked(d).join(truth.withColumn("y", F.lit(1)), ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    kept = lab.join(F.broadcast(points), F.col("p") > F.when(F.col("rk") == 1, F.col("t1")).otherwise(F.col("t2")))
    got = kept.groupBy("t1", "t2", "s1").agg(F.count("*").alias("np"), F.sum("y").alias("tp"))
    nt = queries.select("s1", by).join(truth.groupBy("s1").agg(F.count("*").alias("nt")), "s1", "left").fillna(0, ["nt"])
    some = got.join(nt, "s1").groupBy(by, "t1", "t2").agg(F.sum(f_beta(F.col("tp"), F.col("np"), F.col("nt"))).alias("f"), F.sum((F.col("nt") == 0).cast("int")).alias("wrong"))
    empty = nt.groupBy(by).agg(F.count("*").alias("n"), F.sum((F.col("nt") == 0).cast("int")).alias("zero"))
    each = empty.join(F.broadcast(points)).join(some, [by, "t1", "t2"], "left")
    each = each.select(by, "t1", "t2", F.round((F.coalesce("f", F.lit(0.0)) + F.col("zero") - F.coalesce("wrong", F.lit(0))) / F.col("n"), 6).alias("f"))
    return each.groupBy(by).agg(F.max(F.struct("f", (-F.col("t1")).alias("a"), (-F.col("t2")).alias("b"))).alias("m")).select(by, (-F.col("m.a")).alias("t1"), (-F.col("m.b")).alias("t2"), F.col("m.f").alias("f"))


def tune_gamma(d: DataFrame, truth: DataFrame, queries: DataFrame, gammas=(0.7, 0.85, 1.0, 1.15, 1.3)) -> DataFrame:
    """(gamma, f05): macro F of the expected-F decision with p to the power of each gamma; a row per value."""
    from .metrics import macro_f

    rows = [macro_f(source_caps(expected_f_decode(d, g)), truth, queries).select(F.lit(float(g)).alias("gamma"), "f05") for g in gammas]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out
