"""Gradient-boosted pair models, their stack, calibration and the training-pair builder."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def fold(c: Column) -> Column:
    """0..99 from the md5 of an id, the same in any engine: A below 60, B below 90, C the rest."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % 100


def _filled(d: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Missing values become -1 and a flag of their own."""
    d = d.select("*", *(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"f_{c}") for c in features), *(F.col(c).isNull().cast("double").alias(f"m_{c}") for c in features))
    return d, [f"{k}_{c}" for k in "fm" for c in features]


def fit_matcher(d: DataFrame, features: list[str], label: str = "y", iterations: int = 40, depth: int = 5) -> PipelineModel:
    """Level 1: boosted trees on folds A, stopped early on folds B."""
    rows, cols = _filled(d.filter(fold(F.col("s1")) < 90).withColumn("is_b", fold(F.col("s1")) >= 60), features)
    gbt = GBTClassifier(labelCol=label, featuresCol="x", maxIter=iterations, maxDepth=depth, stepSize=0.1, validationIndicatorCol="is_b", seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="x"), gbt]).fit(rows.withColumn(label, F.col(label).cast("double")))


def predict(model, d: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    rows, _ = _filled(d, features)
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1]).select(*d.columns, out)


def fit_stack(d: DataFrame, features: list[str], label: str = "y") -> PipelineModel:
    """Level 2 over features, p and other scorers' logits; its caller keeps it only for a gain on fold C."""
    rows, cols = _filled(d, features)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="x"), LogisticRegression(labelCol=label, featuresCol="x", regParam=1e-3)]).fit(rows.withColumn(label, F.col(label).cast("double")))


def calibrate(d: DataFrame, label: str = "y"):
    """Isotonic calibration of p."""
    return IsotonicRegression(featuresCol="p", labelCol=label, predictionCol="p_cal").fit(d.withColumn(label, F.col(label).cast("double")))


def auc(d: DataFrame, label: str = "y") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="p", labelCol=label).evaluate(d.withColumn(label, F.col(label).cast("double")))


def logloss(d: DataFrame) -> DataFrame:
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return d.agg(F.round(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))), 6).alias("logloss"))


def s1_aggregate(d: DataFrame) -> DataFrame:
    """Inputs of the model of whether a query has any match."""
    rk = F.row_number().over(W.Window.partitionBy("s1").orderBy(F.col("p").desc(), "r"))
    return d.withColumn("k", rk).groupBy("s1").agg(
        F.max(F.when(F.col("k") == 1, F.col("p"))).alias("p1"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("p"))), F.lit(0.0)).alias("p2"),
        F.round(F.sum("p"), 6).alias("psum"), F.count(F.when(F.col("p") > 0.5, 1)).alias("n05"), F.count("*").alias("nc"),
    )


def hard_pairs(d: DataFrame, hard: int = 10, random: int = 2) -> DataFrame:
    """All true pairs, and per query the hardest and some random false ones (by md5, so always the same)."""
    own = W.Window.partitionBy("s1", "y")
    d = d.withColumn("h", F.row_number().over(own.orderBy(F.col("p").desc(), "r"))).withColumn("m", F.row_number().over(own.orderBy(F.md5(F.concat("s1", "r")), "r")))
    return d.filter((F.col("y") == 1) | (F.col("h") <= hard) | (F.col("m") <= random)).drop("h", "m")


def pseudo_labels(d: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    return d.filter((F.col("p") <= low) | (F.col("p") >= high)).withColumn("y", (F.col("p") >= high).cast("int"))


def score_band(d: DataFrame, scorer, schema: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """A heavy scorer (batches in, batches out) on the uncertain band alone."""
    return d.filter((F.col("p") > low) & (F.col("p") < high)).mapInPandas(scorer, schema)


#: inputs of the model of whether a query has any match (columns of ``head_inputs``)
HEAD_COLUMNS = ["p1", "p2", "psum", "n05", "nc", "nm_max", "num_max", "n_house_eq", "noaddr", "ncore", "rev_max"]


def head_inputs(d: DataFrame) -> DataFrame:
    """(s1, *HEAD_COLUMNS) from scored pairs with features; columns that the pairs lack are null."""
    for c, kind in (("nm_tset", "double"), ("num_jacc", "double"), ("house_rel", "int"), ("noaddr_s", "boolean"), ("n_core_s", "long"), ("rev_margin", "double")):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast(kind))
    more = d.groupBy("s1").agg(
        F.max("nm_tset").alias("nm_max"), F.max("num_jacc").alias("num_max"), F.count(F.when(F.col("house_rel") == 0, 1)).alias("n_house_eq"),
        F.max(F.col("noaddr_s").cast("int")).alias("noaddr"), F.max("n_core_s").alias("ncore"), F.max("rev_margin").alias("rev_max"),
    )
    return s1_aggregate(d).join(more, "s1")


def fit_head(d: DataFrame, truth: DataFrame, iterations: int = 40, depth: int = 4) -> PipelineModel:
    """Whether a query has any match, learnt on the queries of folds A and stopped early on folds B."""
    rows = head_inputs(d).join(truth.select("s1").distinct().withColumn("y", F.lit(1)), "s1", "left").fillna(0, ["y"])
    return fit_matcher(rows, HEAD_COLUMNS, iterations=iterations, depth=depth)


def head_scores(head, d: DataFrame) -> DataFrame:
    """(s1, h) for ``decide`` with the rule ``head``."""
    return predict(head, head_inputs(d), HEAD_COLUMNS, "h").select("s1", "h")


def fit_level(d: DataFrame, features: list[str], label: str = "y", iterations: int = 40, depth: int = 5, seed: int = 13) -> PipelineModel:
    """A further level of boosted trees (over scores of lower levels and other features), on a half of the queries, stopped early on the other."""
    half = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), "s1")), 1, 8), 16, 10).cast("long") % 2 == 1
    rows, cols = _filled(d.withColumn("held", half), features)
    gbt = GBTClassifier(labelCol=label, featuresCol="x", maxIter=iterations, maxDepth=depth, stepSize=0.1, validationIndicatorCol="held", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="x"), gbt]).fit(rows.withColumn(label, F.col(label).cast("double")))


def gated(base: DataFrame, other: DataFrame, decide_by, truth: DataFrame, gate: float) -> tuple[bool, float]:
    """(whether to take the other scores, gain): macro F of both by ``decide_by`` on the same queries; taken from a gain of ``gate`` on."""
    from .metrics import macro_f

    queries = base.select("s1").distinct()
    own = truth.join(queries, "s1", "left_semi")
    a, b = (macro_f(decide_by(d), own, queries).first().f05 for d in (base, other))
    return b - a >= gate, b - a


def blended(d: DataFrame, judges: list[str], label: str = "y", low: float = 0.005, high: float = 0.995) -> PipelineModel:
    """A logistic blend of logit(p) and of judges' logits, fitted on the uncertain band where all judges have said something."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = d.filter((F.col("p") > low) & (F.col("p") < high)).dropna(subset=judges).withColumn("lp", F.log(p / (1 - p))).withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=["lp", *judges], outputCol="x"), LogisticRegression(labelCol=label, featuresCol="x", regParam=1e-3)]).fit(rows)


def blend(model: PipelineModel, d: DataFrame, judges: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """``d`` with p from the blend on its band, and as it was elsewhere and where a judge is silent."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    inside = (F.col("p") > low) & (F.col("p") < high)
    for j in judges:
        inside = inside & F.col(j).isNotNull()
    rows = d.withColumn("inside", inside).withColumn("lp", F.log(p / (1 - p))).fillna(0.0, judges)
    out = model.transform(rows).withColumn("p", F.when(F.col("inside"), vector_to_array("probability")[1]).otherwise(F.col("p")))
    restored = [F.when(F.col("inside"), F.col(j)).otherwise(F.lit(None)).alias(j) if j in judges else F.col(j) for j in d.columns]
    return out.select(*restored)


def street_twins(pairs: DataFrame, records: DataFrame, number: int = 1000) -> DataFrame:
    """(s1, r, entity_id, business_name, business_address, country): false copies of true pairs, with another record's street.

    ``number`` pairs and as many donors by md5, so always the same; donors are of the pair's country and met by rank.
    """
    part = F.get(F.filter(F.split("business_address", ","), lambda x: x.rlike(r"\d")), F.lit(0))
    d = records.withColumn("part", part).filter(F.col("part").isNotNull())
    bare = F.regexp_replace("part", r"^\D*\d+\w*\s*", "")
    order = lambda c, salt: F.row_number().over(W.Window.partitionBy("country").orderBy(F.md5(F.concat(F.lit(salt), c)), c))
    chosen = pairs.select("s1", "r").withColumn("m", F.md5(F.concat("s1", "r"))).orderBy("m", "s1", "r").limit(number)
    a = chosen.join(d.withColumnRenamed("entity_id", "r"), "r").withColumn("k", order("r", "a"))
    b = d.filter(F.length(bare) >= 4).select("country", F.col("entity_id").alias("donor"), bare.alias("street")).withColumn("k", order("donor", "b"))
    n = b.groupBy("country").agg(F.max("k").alias("n"))
    met = a.join(F.broadcast(n), "country").withColumn("k", (F.col("k") - 1) % F.col("n") + 1).join(b, ["country", "k"])
    new = F.concat(F.regexp_extract("part", r"^(\D*\d+\w*)", 1), F.lit(" "), F.col("street"))
    at = F.instr("business_address", F.col("part"))
    address = F.concat(F.substring("business_address", F.lit(1), at - 1), new, F.substring("business_address", at + F.length("part"), F.length("business_address")))
    out = met.withColumn("address", address).filter(F.col("address") != F.col("business_address"))
    return out.select("s1", "r", F.concat(F.substring("r", 1, 3), F.lit("SYN"), F.substring("r", F.lit(4), F.length("r"))).alias("entity_id"), "business_name", F.col("address").alias("business_address"), "country")


def sampled(d: DataFrame, by: str, n: int) -> DataFrame:
    """``n`` rows in the order of the md5 of a column, the same on every run."""
    return d.withColumn("m", F.md5(F.col(by).cast("string"))).orderBy("m", by).limit(n).drop("m")


def save(model, cfg: dict, path: str) -> None:
    """A model and its decision config below one folder of any store."""
    import json

    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(cfg, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark, path: str) -> tuple[PipelineModel, dict]:
    import json

    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/config").first().value)
