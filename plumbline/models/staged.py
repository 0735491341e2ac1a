"""Every prefix of a boosted ensemble scored at once, and stopping by average precision.

Boosting with n trees holds the boosted models of 1 to n - 1 trees inside it. A row's leaf in each tree gives the
running margins of all prefixes in one pass inside the JVM; average precision of every prefix then comes from one grouped
score profile, where the prefix is part of the key. Only one number per prefix reaches the driver.
"""

from __future__ import annotations

import json
import re

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from plumbline.operators.metrics import profile_metrics, score_profile


def leaf_values(model: PipelineModel) -> list[list[float]]:
    """Per tree, what each leaf (left to right, as Spark numbers them) adds to the margin."""
    last = model.stages[-1]
    shown = (tree.toDebugString() for tree in last._java_obj.trees())
    return [[weight * float(x) for x in re.findall(r"Predict: (\S+)", text)] for weight, text in zip(last.treeWeights, shown)]


def staged_margins(model: PipelineModel, df: DataFrame, name: str = "margins") -> DataFrame:
    """Adds the margins of the first 1, 2, ... trees as an array; the probability is 1 / (1 + exp(-2 margin))."""
    boosted = model.stages[-1].copy().setLeafCol("_leaves")
    rows = PipelineModel([*model.stages[:-1], boosted]).transform(df)
    rows = rows.drop("probability", "rawPrediction", "prediction", "features")
    values = F.from_json(F.lit(json.dumps(leaf_values(model))), "array<array<double>>")
    rows = rows.withColumns({"_values": values, "_leaves": vector_to_array("_leaves")})
    added = "zip_with(_leaves, _values, (leaf, v) -> v[int(leaf)])"
    running = f"slice(aggregate({added}, array(0D), (sums, x) -> concat(sums, array(element_at(sums, -1) + x))), 2, size(_leaves))"
    return rows.withColumn(name, F.expr(running)).drop("_leaves", "_values")


def staged_precision(model: PipelineModel, df: DataFrame, y: str, weight: str | None = None) -> DataFrame:
    """(n_trees, pr_auc) of every prefix on the rows of `df`."""
    keep = [F.col(y).alias("_y"), *([F.col(weight).alias("_w")] if weight else [])]
    scored = staged_margins(model, df).select(*keep, F.posexplode("margins").alias("_at", "_margin"))
    scored = scored.withColumn("n_trees", F.col("_at") + 1)
    profile = score_profile(scored, "_y", "_margin", ["n_trees"], weight="_w" if weight else None)
    return profile_metrics(profile, by=["n_trees"]).select("n_trees", "pr_auc")


def stopping_point(curve: list[tuple[int, float]], patience: int) -> int:
    """The prefix of largest average precision (the smallest of equal ones) among those before `patience` prefixes in a row
    bring nothing better; all trees where no prefix has a value."""
    best, at = float("-inf"), None
    for n, value in sorted(curve):
        if at is not None and n - at > patience:
            break
        if value > best:  # never true of NaN
            best, at = value, n
    return at if at is not None else max((n for n, _ in curve), default=0)


def truncated(model: PipelineModel, n_trees: int) -> PipelineModel:
    """The same pipeline with the first `n_trees` trees."""
    last = model.stages[-1]
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    trees, weights = list(last._java_obj.trees())[:n_trees], list(last.treeWeights)[:n_trees]
    kept = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    numbers = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        kept[i], numbers[i] = tree, float(weight)
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(last.uid, kept, numbers, last.numFeatures, 2)
    shorter = GBTClassificationModel(java)
    for param in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol", "leafCol"):
        if last.hasParam(param) and last.isDefined(last.getParam(param)):
            shorter._set(**{param: last.getOrDefault(param)})
    shorter._transfer_params_to_java()
    return PipelineModel([*model.stages[:-1], shorter])


def stop_by_precision(model: PipelineModel, watch: DataFrame, y: str, patience: int, weight: str | None = None) -> PipelineModel:
    """`model` cut at its stopping point on the rows of `watch`."""
    curve = [(r.n_trees, r.pr_auc) for r in staged_precision(model, watch, y, weight).collect()]  # a row for each tree
    return truncated(model, stopping_point(curve, patience)) if curve else model
