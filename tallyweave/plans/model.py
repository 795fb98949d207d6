"""Training, scoring and tuning of the pair classifier."""

from __future__ import annotations

import itertools
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import decide
from tallyweave.operators.evaluate import _with_all, counts, summary
from tallyweave.operators.features import FS43


def class_balance(labelled: DataFrame) -> DataFrame:
    """Positive and negative pairs and the weight that evens them out."""
    return labelled.agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative")).withColumn("positive_weight", F.when(F.col("positive") == 0, 1.0).otherwise(F.col("negative") / F.col("positive")))


def in_split(s1_id: str = "s1_id", share: float = 0.2):
    """Whether an anchor belongs to the validation split: by its id's hash, so whole anchors are split and the same ones everywhere."""
    return F.pmod(F.xxhash64(s1_id), F.lit(1000)) < int(1000 * share)


def hard_negatives(labelled: DataFrame, least: float = 0.85) -> DataFrame:
    return labelled.where((F.col("label") == 0) & (F.col("jw_name") >= least))


def fit(labelled: DataFrame, features: list[str] = FS43, trees: int = 20, depth: int = 5, step: float = 0.2, positive_weight: float = 1.4, early_stop: bool = False, seed: int = 7) -> PipelineModel:
    """A gradient-boosted classifier of pairs; ``early_stop`` holds out a split of anchors and stops when it no longer gains."""
    rows = labelled.withColumn("_weight", F.when(F.col("label") == 1, positive_weight).otherwise(1.0)).withColumn("_aside", in_split(share=0.1))
    boost = GBTClassifier(featuresCol="_vector", labelCol="label", weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, predictionCol="_prediction").setProbabilityCol("_probability").setRawPredictionCol("_raw")
    if early_stop:
        boost.setValidationIndicatorCol("_aside").set(boost.validationTol, 0.001)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_vector"), boost]).fit(rows)


def scored(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Pairs with ``prob``."""
    done = model.transform(pairs).withColumn("prob", vector_to_array("_probability")[1])
    return done.drop("_vector", "_probability", "_prediction", "_raw")


def importances(model: PipelineModel, features: list[str] = FS43) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, thresholds: dict[str, float], path: str, spark: SparkSession) -> None:
    """The model, and beside it its thresholds as JSON."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(thresholds),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/thresholds")


def load(path: str, spark: SparkSession) -> tuple[PipelineModel, dict[str, float]]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/thresholds").first()[0])


# The thresholds that were tried for the first, second and third match.
THREE_TIERS = ([0.65, 0.70, 0.75, 0.78, 0.80, 0.82, 0.85], [0.80, 0.84, 0.87, 0.90], [0.88, 0.92, 0.95])


def tier_grid(anchors: DataFrame, truth: DataFrame, pairs: DataFrame, tiers: tuple[list[float], ...], total: int = 4) -> DataFrame:
    """Macro F0.5 of the training-time rule for each setting of one threshold for each tier, none below the one before it, in one job.

    Pairs are ranked once; a pair is kept under a setting if it reaches that setting's threshold for its rank (the last one's from there on).
    """
    settings = [s for s in itertools.product(*tiers) if all(x <= y for x, y in itertools.pairwise(s))]
    ranked = decide._ranked(pairs, ("s1_id",), decide._best()).where(F.col("rank") <= total)
    grid = F.explode(F.array(*(F.struct(F.lit("/".join(map(str, s))).alias("setting"), F.array(*map(F.lit, s)).alias("t")) for s in settings))).alias("g")
    rows = ranked.select("s1_id", "cand_id", "prob", "rank", grid).where(F.col("prob") >= F.element_at("g.t", F.least(F.col("rank"), F.lit(len(tiers)))))
    named = rows.select(F.col("g.setting").alias("setting"), "s1_id", "cand_id")
    return summary(_with_all(anchors, truth, named, ["/".join(map(str, s)) for s in settings], "setting"), ("setting",))


def two_tier_grid(anchors: DataFrame, truth: DataFrame, pairs: DataFrame, primary: list[float], secondary: list[float], total: int = 4) -> DataFrame:
    return tier_grid(anchors, truth, pairs, (primary, secondary), total)


def three_tier_grid(anchors: DataFrame, truth: DataFrame, pairs: DataFrame, tiers: tuple[list[float], list[float], list[float]] = THREE_TIERS) -> DataFrame:
    """The grid over the first three matches of an anchor."""
    return tier_grid(anchors, truth, pairs, tiers, 3)


def fold_spread(spark: SparkSession, scores: list[float]) -> DataFrame:
    """(folds, mean, std) of cross-validation scores, std being that of the folds themselves."""
    return spark.createDataFrame([(float(x),) for x in scores], "score double").agg(F.count(F.lit(1)).alias("folds"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def cross_validated(labelled: DataFrame, anchors: DataFrame, truth: DataFrame, folds: int = 5, threshold: float = 0.5, **options) -> list[float]:
    """Macro F0.5 of each fold; folds are of anchors, so that no anchor is on both sides."""
    fold = F.pmod(F.xxhash64("s1_id", F.lit(folds)), F.lit(folds))
    scores = []
    for k in range(folds):
        model = fit(labelled.where(fold != k), **options)
        kept = scored(model, labelled.where(fold == k)).where(F.col("prob") >= threshold)
        scores.append(summary(counts(anchors.where(fold == k), truth.where(fold == k), kept)).first()["macro_f05"])
    return scores
