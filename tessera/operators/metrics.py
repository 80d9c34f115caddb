"""Macro F, recall, ceilings and attribution of misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def f_beta(tp: Column, n_pred: Column, n_true: Column, beta: float = 0.5) -> Column:
    """1 where nothing is predicted and nothing true, 0 without a hit."""
    b2 = beta * beta
    return F.when((n_pred == 0) & (n_true == 0), F.lit(1.0)).when(tp == 0, F.lit(0.0)).otherwise((1 + b2) * tp / (b2 * n_true + n_pred))


def per_query(pred: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(s1, tp, np, nt, f) of every query, those without predictions and truth too."""
    both = pred.select("s1", "r").distinct().withColumn("a", F.lit(1)).join(truth.select("s1", "r").distinct().withColumn("b", F.lit(1)), ["s1", "r"], "full")
    n = both.groupBy("s1").agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("tp"), F.count("a").alias("np"), F.count("b").alias("nt"))
    full = queries.select("s1").join(n, "s1", "left").select("s1", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "np", "nt")))
    return full.withColumn("f", F.round(f_beta(F.col("tp"), F.col("np"), F.col("nt")), 9))


def macro_f(pred: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    d = per_query(pred, truth, queries)
    single = F.col("nt") == 0
    return d.agg(
        F.round(F.avg("f"), 6).alias("f05"), F.round(F.avg(F.when(single, F.col("f"))), 6).alias("f05_single"), F.round(F.avg(F.when(~single, F.col("f"))), 6).alias("f05_other"),
        F.round(F.try_divide(F.sum("tp"), F.sum("np")), 6).alias("precision"), F.round(F.try_divide(F.sum("tp"), F.sum("nt")), 6).alias("recall"),
    )


def true_lists(truth: DataFrame) -> DataFrame:
    """(s1, ts): the true records of a query."""
    return truth.groupBy("s1").agg(F.collect_list("r").alias("ts"))


def pool_recall(pairs: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Pair recall, share of queries with all their records, candidates a query: mean and 95th percentile."""
    return list_recall(pairs.groupBy("s1").agg(F.collect_list("r").alias("rs")), truth, queries)


def list_recall(lists: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """``pool_recall`` of (s1, rs), the candidates of a query as a list: no row for a pair."""
    none = F.array().cast("array<string>")
    d = queries.select("s1").join(true_lists(truth), "s1", "left").join(lists, "s1", "left").select(F.coalesce("ts", none).alias("ts"), F.coalesce("rs", none).alias("rs"))
    d = d.select(F.size("ts").alias("nt"), F.size(F.filter("ts", lambda x: F.array_contains("rs", x))).alias("tp"), F.size("rs").alias("n"))
    return d.agg(
        F.round(F.sum("tp") / F.sum("nt"), 6).alias("pair_recall"), F.round(F.avg((F.col("nt") == F.col("tp")).cast("double")), 6).alias("complete"),
        F.round(F.avg("n"), 6).alias("cands"), F.round(F.percentile("n", 0.95), 6).alias("p95"),
    )


def ceiling(pairs: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """What perfect decisions on the pool would score."""
    return macro_f(pairs.select("s1", "r").join(truth, ["s1", "r"], "left_semi"), truth, queries)


def attribution(pred: DataFrame, pairs: DataFrame, truth: DataFrame, other: DataFrame) -> DataFrame:
    """(bucket, n): why true pairs were missed: not in the pool, given to another query, below the threshold."""
    miss = truth.join(pred.select("s1", "r"), ["s1", "r"], "left_anti")
    d = miss.join(pairs.select("s1", "r", F.lit(1).alias("in_pool")).distinct(), ["s1", "r"], "left").join(other.select("r", F.lit(1).alias("taken")).distinct(), "r", "left")
    return d.groupBy(F.when(F.col("in_pool").isNull(), "not_in_pool").when(F.col("taken").isNotNull(), "other_owner").otherwise("threshold").alias("bucket")).agg(F.count("*").alias("n"))


def pareto(points: DataFrame) -> DataFrame:
    """Points (cands, complete) that no point with fewer candidates reaches. For a few points: the window is one partition."""
    before = W.Window.orderBy("cands", F.col("complete").desc()).rowsBetween(W.Window.unboundedPreceding, -1)
    return points.withColumn("m", F.max("complete").over(before)).filter(F.col("m").isNull() | (F.col("complete") > F.col("m"))).drop("m")


def recall_slices(pairs: DataFrame, truth: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """(slice, n, recall): share of true pairs in the pool, of all, by the query's country, of records without an address and with Indic names."""
    hit = truth.select("s1", "r").join(pairs.select("s1", "r").distinct().withColumn("hit", F.lit(1.0)), ["s1", "r"], "left").fillna(0.0, ["hit"])
    q = queries.select(F.col("entity_id").alias("s1"), F.concat(F.lit("country:"), F.col("country")).alias("c"))
    r = records.select(F.col("entity_id").alias("r"), F.when(F.col("noaddr"), F.lit("noaddr")).alias("n"), F.when(F.col("indic"), F.lit("indic")).alias("i"))
    each = hit.join(q, "s1", "left").join(r, "r", "left").select("hit", F.explode(F.array_compact(F.array(F.lit("all"), F.col("c"), F.col("n"), F.col("i")))).alias("slice"))
    return each.groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("recall"))


def orphan_f(pred: DataFrame, truth: DataFrame, queries: DataFrame, weight: float = 2.0) -> DataFrame:
    """(f05) where a wrong pair with a record that no query owns counts ``weight`` times."""
    owned = truth.select("r").distinct().withColumn("owned", F.lit(1))
    d = pred.select("s1", "r").distinct().join(truth.select("s1", "r", F.lit(1).alias("hit")), ["s1", "r"], "left").join(owned, "r", "left")
    d = d.groupBy("s1").agg(F.count("hit").alias("tp"), F.sum(F.when(F.col("owned").isNull(), F.lit(weight)).otherwise(F.lit(1.0))).alias("np"))
    nt = truth.groupBy("s1").agg(F.count("*").alias("nt"))
    full = queries.select("s1").join(d, "s1", "left").join(nt, "s1", "left").fillna(0)
    return full.agg(F.round(F.avg(F.round(f_beta(F.col("tp"), F.col("np"), F.col("nt")), 9)), 6).alias("f05"))


def transfer_rate(pred: DataFrame, pseudo: DataFrame) -> DataFrame:
    """(n, hit, other): of label-free pairs the share that is predicted, and the share whose record goes to another query."""
    d = pseudo.select("s1", "r").distinct().join(pred.select("r", F.col("s1").alias("to")).distinct(), "r", "left")
    d = d.groupBy("s1", "r").agg(F.max((F.col("to") == F.col("s1")).cast("int")).alias("own"), F.count("to").alias("n_to"))
    own = F.coalesce("own", F.lit(0))
    return d.agg(F.count("*").alias("n"), F.round(F.avg(own.cast("double")), 6).alias("hit"), F.round(F.avg(((own == 0) & (F.col("n_to") > 0)).cast("double")), 6).alias("other"))


def profile(records: DataFrame, patterns: dict[str, str], columns=("business_name", "business_address")) -> DataFrame:
    """(field, n, n_unique, missing, and a share per pattern) of text columns by country, one pass for all of them."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("x")) for c in columns)))
    d = records.select("country", parts.alias("p")).select("country", "p.*")
    none = F.coalesce(F.trim("x") == "", F.lit(True))
    rates = [F.round(F.avg(F.coalesce(F.col("x").rlike(p), F.lit(False)).cast("double")), 6).alias(name) for name, p in patterns.items()]
    return d.groupBy("country", "field").agg(F.count("*").alias("n"), F.count_distinct("x").alias("n_unique"), F.round(F.avg(none.cast("double")), 6).alias("missing"), F.round(F.median(F.length("x")), 6).alias("median_length"), *rates)


def contingency(pairs: DataFrame, rows: str, cols: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` by the listed values of ``cols``, a column each."""
    return pairs.groupBy(rows).pivot(cols, values).agg(F.count(F.lit(1))).fillna(0)


def id_gaps(records: DataFrame, by: str, number: str) -> DataFrame:
    """(by, n, gap_1, longest, corr): do ids of a group follow each other, and do they go with the order of the table? A check for leaks."""
    own = W.Window.partitionBy(by).orderBy(number)
    d = records.select(by, number, (F.col(number) - F.lag(number).over(own)).alias("gap"), F.row_number().over(own).alias("at"))
    return d.groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(F.col("gap") == 1, 1)).alias("gap_1"), F.max("gap").alias("longest"), F.round(F.corr(number, "at"), 6).alias("corr"))


def ownership(truth: DataFrame, records: DataFrame, queries: DataFrame) -> DataFrame:
    """(orphans, singles, shared): shares of records without a query and of queries without a record, and the number of records with two."""
    r = records.select(F.col("entity_id").alias("r")).join(truth.groupBy("r").agg(F.count("*").alias("n")), "r", "left").fillna(0)
    q = queries.select("s1").join(truth.groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").fillna(0)
    a = r.agg(F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("orphans"), F.count(F.when(F.col("n") > 1, 1)).alias("shared"))
    return a.join(q.agg(F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("singles"))).select("orphans", "singles", "shared")  # a row each


def oracle_gains(pred: DataFrame, pairs: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(f05, no_wrong, all_found, both): macro F as it is, without the wrong pairs, with all true pairs of the pool, and with both."""
    p, t = pred.select("s1", "r").distinct(), truth.select("s1", "r")
    right = p.join(t, ["s1", "r"], "left_semi")
    found = pairs.select("s1", "r").distinct().join(t, ["s1", "r"], "left_semi")
    kinds = (("f05", p), ("no_wrong", right), ("all_found", p.unionByName(found).distinct()), ("both", right.unionByName(found).distinct()))
    out = None
    for name, x in kinds:
        one = macro_f(x, truth, queries).select(F.col("f05").alias(name))
        out = one if out is None else out.join(one)  # a row each
    return out
