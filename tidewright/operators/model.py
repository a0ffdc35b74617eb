"""Baseline and trained forecasts (CMP-27/28/31, SRT-07/09), with Spark ML."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import regression, sufficient


def persistence(df: DataFrame, current: str, name: str = "persistence_prediction") -> DataFrame:
    """CMP-27: what is now will be."""
    return df.withColumn(name, F.col(current))


@dataclass(frozen=True)
class Candidate:
    name: str
    trees: int
    depth: int
    rate: float = 0.1


def fit(train: DataFrame, features: list[str], label: str, candidate: Candidate, seed: int = 42):
    """A pipeline of gradient-boosted trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    vector = VectorAssembler(inputCols=features, outputCol="_features")
    trees = GBTRegressor(featuresCol="_features", labelCol=label, maxIter=candidate.trees, maxDepth=candidate.depth, stepSize=candidate.rate, seed=seed)
    return Pipeline(stages=[vector, trees]).fit(train)


def search(train: DataFrame, valid: DataFrame, features: list[str], label: str, candidates: list[Candidate], seed: int = 42):
    """CMP-28: (name of the winner, its model, a row of metrics for each candidate).

    Ranked by error, then squared error, then size, then name; TEST rows are not looked at here (CMP-31).
    """
    fitted, rows = {}, None
    for c in candidates:
        fitted[c.name] = fit(train, features, label, c, seed)
        scored = fitted[c.name].transform(valid).agg(*sufficient("prediction", label))
        row = scored.select(F.lit(c.name).alias("candidate"), F.lit(c.trees * c.depth).alias("size"), *(v.alias(k) for k, v in regression().items()))
        rows = row if rows is None else rows.unionByName(row)
    winner = ranked(rows).first()["candidate"]
    return winner, fitted[winner], rows


def frozen(train: DataFrame, valid: DataFrame, test: DataFrame, features: list[str], label: str, candidates: list[Candidate], folder: str, seed: int = 42) -> DataFrame:
    """CMP-28/31: choose, freeze, refit, reload, and only then read TEST, once.  One row of what came out.

    The winner with its parameters, features and their SHA-256 is written to ``folder``/frozen before TEST is read; a
    folder that has one already is an error, so nothing can be chosen again after TEST was seen.  The winner is refitted on
    TRAIN and VALIDATION, saved to ``folder``/model, and the saved model is read back and held to the fitted one.
    """
    from pyspark.ml import PipelineModel

    spark = train.sparkSession
    name, _, _ = search(train, valid, features, label, candidates, seed)
    winner = next(c for c in candidates if c.name == name)
    text = json.dumps({**asdict(winner), "features": features, "label": label, "seed": seed}, sort_keys=True)
    digest = hashlib.sha256(text.encode()).hexdigest()
    spark.createDataFrame([(text, digest)], "parameters string, sha256 string").write.mode("errorifexists").json(f"{folder}/frozen")
    both = train.unionByName(valid)
    refitted = fit(both, features, label, winner, seed)
    refitted.write().save(f"{folder}/model")
    reloaded = PipelineModel.load(f"{folder}/model")
    again = reloaded.transform(refitted.transform(valid).withColumnRenamed("prediction", "_first").drop("_features"))
    parity = again.agg(F.max(F.abs(F.col("prediction") - F.col("_first"))).alias("reload_difference"))
    agreed = spark.read.json(f"{folder}/frozen").select("parameters", (F.sha2("parameters", 256) == F.col("sha256")).alias("frozen_unchanged"))
    seen = reloaded.transform(test).agg(*sufficient("prediction", label))
    metrics = seen.select(*(v.alias(f"test_{k}") for k, v in regression().items()), F.col("n").alias("test_rows"))
    return agreed.join(parity).join(metrics).withColumn("winner", F.lit(name))  # single rows


def ranked(metrics: DataFrame) -> DataFrame:
    """SRT-07."""
    return metrics.orderBy("mae", "rmse", "size", "candidate")


def fit_until(train: DataFrame, valid: DataFrame, features: list[str], label: str, candidate: Candidate, seed: int = 42, tolerance: float = 0.01):
    """CMP-28: ``fit`` that adds trees only while the error of ``valid`` falls by more than ``tolerance``, ``candidate.trees`` at most."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    names = [*features, label]
    both = train.select(*names, F.lit(False).alias("_held")).unionByName(valid.select(*names, F.lit(True).alias("_held")))
    trees = GBTRegressor(featuresCol="_features", labelCol=label, maxIter=candidate.trees, maxDepth=candidate.depth, stepSize=candidate.rate, seed=seed, validationIndicatorCol="_held", validationTol=tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), trees]).fit(both)


def nodes(spark, path: str) -> DataFrame:
    """The nodes of a tree ensemble that was saved to ``path`` (a pipeline that ends with it), as rows.

    tree, node, rows, prediction, impurity, gain (the fall of squared error, summed over the node's rows; null for a
    leaf), feature (its index; null for a leaf), threshold, left and right.
    """
    # the last stage's folder is known by its number, which the pipeline pads to one width
    stages = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/stages").select("path")
    last = stages.filter(F.col("path").rlike("/data/[^/]*$")).agg(F.max(F.regexp_extract("path", "(.*/data)/[^/]*$", 1))).first()[0]
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    return spark.read.parquet(last).select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["rawCount"].alias("rows"), n["prediction"].alias("prediction"), n["impurity"].alias("impurity"),
        F.when(inner, n["gain"] * n["rawCount"]).alias("gain"), F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"), F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
    )


def importance(spark, path: str, features: list[str]) -> DataFrame:
    """SRT-09 of a saved ensemble: of each feature weight (how many nodes split by it), total_gain and gain (of a split, on average).

    In order of gain, then weight, both downwards, then name; features that no node uses come last with zeros.
    """
    named = spark.createDataFrame(list(enumerate(features)), "feature int, name string")
    used = nodes(spark, path).filter("feature is not null").groupBy("feature").agg(F.count("*").alias("weight"), F.sum("gain").alias("total_gain"))
    out = named.join(used, "feature", "left").fillna(0).withColumn("gain", F.coalesce(F.col("total_gain") / F.nullif("weight", F.lit(0)), F.lit(0.0)))
    return out.select(F.col("name").alias("feature"), "gain", "weight", "total_gain").orderBy(F.col("gain").desc(), F.col("weight").desc(), "feature")
