"""Training on Spark ML. Every model reads one ordered list of feature columns and a 0/1 label."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from plumbline import fixed_values as fv
from plumbline.config import TrainConfig
from plumbline.functions.scores import encode_target
from plumbline.operators.metrics import profile_metrics, score_profile
from plumbline.models.staged import stop_by_precision
from plumbline.operators.quality import feature_contract
from plumbline.session import stage

LABEL, WEIGHT, VALIDATION, EXAMPLE = "y", "weight", "is_validation", "example_weight"
TASK_ROWS = 2048


def training_matrix(
    df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Ordered double features plus `y`; a missing feature or a stray label raises."""
    extra = [c for c in keep if c in df.columns]
    target = df.withColumn(LABEL, encode_target(F.col(label)).cast("double"))
    return feature_contract(target, features, [*extra, LABEL])


def _parts(df: DataFrame, n: int) -> int:
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))


def dealt(df: DataFrame, n: int) -> DataFrame:
    """The `n` rows of `df` in even parts, one per core: a fit goes over them some hundred times, and a part too many or a
    few large ones leave most cores idle every time. Few rows stay in fewer parts."""
    return df.repartition(_parts(df, n))


def merged(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Equal rows as one with the sum of their `example_weight`, in an order that the values alone decide.

    Beyond 10,000 rows Spark takes split candidates from a sample of them. Rows repeated by their weight so are the same
    input, and give the same sample, as weighted rows.
    """
    own = F.coalesce(F.col(EXAMPLE).cast("double"), F.lit(0.0)) if EXAMPLE in df.columns else F.lit(1.0)
    keys = [*features, LABEL]
    rows = stage(df.groupBy(*keys).agg(F.sum(own).alias(EXAMPLE)).where(F.col(EXAMPLE) > 0))
    return rows.repartition(_parts(rows, rows.count()), *keys).sortWithinPartitions(*keys)


def balanced(df: DataFrame, positives_only: bool = False) -> DataFrame:
    """Weights that balance the classes: n / (2 n_c), or n_neg / n_pos on positives alone.

    Rows marked in `is_validation` are weighted like the others but do not count. A column `example_weight` counts rows
    by its values, and multiplies their class weight.
    """
    counted = df.where(~F.col(VALIDATION)) if VALIDATION in df.columns else df
    own = F.col(EXAMPLE).cast("double") if EXAMPLE in df.columns else F.lit(1.0)
    counts = counted.agg(F.sum(own).alias("n"), F.sum(F.col(LABEL) * own).alias("p")).select(F.struct("*")).scalar()
    n, p = counts.getField("n"), counts.getField("p")
    if positives_only:
        w = F.when((F.col(LABEL) == 1) & (p > 0), (n - p) / F.nullif(p, F.lit(0.0))).otherwise(1.0)
    else:
        w = n / F.nullif(2 * F.when(F.col(LABEL) == 1, p).otherwise(n - p), F.lit(0.0))
    return df.withColumn(WEIGHT, w * own)


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def fit_logistic(df: DataFrame, features: Sequence[str], cfg: TrainConfig = TrainConfig()) -> PipelineModel:
    """Standardised inputs, L2 penalty of strength 1/C spread over the summed weights, balanced classes."""
    rows = balanced(df)
    total = rows.agg(F.sum(WEIGHT)).first()[0]
    stages = [
        _assembler(features, "raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            labelCol=LABEL, weightCol=WEIGHT, regParam=1.0 / (cfg.logistic_c * total), elasticNetParam=0.0,
            standardization=False, maxIter=cfg.logistic_iterations,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def fit_forest(df: DataFrame, features: Sequence[str], cfg: TrainConfig = TrainConfig()) -> PipelineModel:
    forest = RandomForestClassifier(
        labelCol=LABEL, weightCol=WEIGHT, numTrees=cfg.forest_trees, maxDepth=min(cfg.forest_depth, 30),
        minInstancesPerNode=cfg.forest_min_leaf, seed=cfg.seed,
    )
    return Pipeline(stages=[_assembler(features), forest]).fit(balanced(df))


def fit_boosted(
    df: DataFrame, features: Sequence[str], cfg: TrainConfig = TrainConfig(), early_stopping: bool = False,
    min_instances: int = 1, feature_share: float = 1.0,
) -> PipelineModel:
    """Gradient-boosted trees. With `early_stopping` the trees are fitted on the rows that are not marked in
    `is_validation`, and kept up to the number with the best average precision on the marked ones (see `staged`).

    Weighted rows give what repeated rows give where each row counts in every tree: `subsample` draws rows, and
    `min_instances` counts them."""
    boosted = GBTClassifier(
        labelCol=LABEL, weightCol=WEIGHT, maxIter=cfg.n_estimators, maxDepth=cfg.max_depth,
        stepSize=cfg.learning_rate, subsamplingRate=cfg.subsample, seed=cfg.seed,
        minInstancesPerNode=min_instances, featureSubsetStrategy=str(feature_share) if feature_share < 1 else "all",
    )
    pipeline = Pipeline(stages=[_assembler(features), boosted])
    rows = df.where(~F.col(VALIDATION)) if early_stopping else df
    if cfg.subsample == 1 and min_instances == 1:
        rows = merged(rows, features)
    model = pipeline.fit(balanced(rows, positives_only=True))
    if not early_stopping:
        return model
    watched = EXAMPLE if EXAMPLE in df.columns else None
    return stop_by_precision(model, df.where(VALIDATION), LABEL, cfg.patience, watched)


def score(model: PipelineModel, df: DataFrame, name: str = "p_lead") -> DataFrame:
    """Add the probability of the positive class; anything but two classes raises."""
    if model.stages[-1].numClasses != 2:
        raise ValueError(f"expected two classes, got {model.stages[-1].numClasses}")
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("probability", "rawPrediction", "prediction", "features", "raw_features")


def average_precision(model: PipelineModel, df: DataFrame) -> float:
    scored = score(model, df, "_p")
    return profile_metrics(score_profile(scored, LABEL, "_p", weight=EXAMPLE if EXAMPLE in df.columns else None)).first()["pr_auc"]


def trial_grid(n: int, seed: int = fv.SEED) -> list[dict]:
    """Seeded random draws from the search space."""
    import numpy as np

    rng = np.random.default_rng(seed)
    return [
        {
            "max_depth": int(rng.integers(3, 9)),
            "learning_rate": float(np.exp(rng.uniform(np.log(0.01), np.log(0.3)))),
            "subsample": float(rng.uniform(0.6, 1.0)),
            "feature_share": float(rng.uniform(0.6, 1.0)),
            "min_instances": int(rng.integers(1, 11)),
        }
        for _ in range(n)
    ]


def search_boosted(
    train: DataFrame, validation: DataFrame, features: Sequence[str], cfg: TrainConfig = TrainConfig()
) -> tuple[dict, DataFrame]:
    """Random search maximising average precision on the validation rows: best draw and the table of trials.

    Every trial stops by average precision. Trials are fitted as concurrent jobs over one written matrix,
    `parallel_trials` at a time; each draw has its own seed-free result, so the number changes nothing but the time.
    No trial begins after `search_seconds`; the first one always runs. Of equal trials the first one counts.
    """
    both = train.withColumn(VALIDATION, F.lit(False)).unionByName(validation.withColumn(VALIDATION, F.lit(True)))
    staged, began = stage(both), time.monotonic()

    def trial(numbered: tuple[int, dict]) -> dict | None:
        i, draw = numbered
        if i and time.monotonic() - began > cfg.search_seconds:
            return None
        tuned = dataclasses.replace(cfg, **{k: draw[k] for k in ("max_depth", "learning_rate", "subsample")})
        model = fit_boosted(staged, features, tuned, True, draw["min_instances"], draw["feature_share"])
        return {"trial": i, **draw, "n_trees": model.stages[-1].getNumTrees, "pr_auc": average_precision(model, staged.where(VALIDATION))}

    with ThreadPoolExecutor(max(1, cfg.parallel_trials)) as pool:
        call = inheritable_thread_target(train.sparkSession)(trial)
        rows = [r for r in pool.map(call, enumerate(trial_grid(cfg.n_trials, cfg.seed))) if r is not None]
    best = max(rows, key=lambda r: (r["pr_auc"] == r["pr_auc"], r["pr_auc"]))
    kinds = "trial int, max_depth int, learning_rate double, subsample double, feature_share double, min_instances int, n_trees int, pr_auc double"
    return best, train.sparkSession.createDataFrame([tuple(r.values()) for r in rows], kinds)


def monotone_audit(
    model: PipelineModel, df: DataFrame, feature: str, grid: Sequence[float], row_id: str, decreasing: bool = True
) -> DataFrame:
    """Score each row at every grid value of one feature; count rows whose score moves the wrong way.

    The grid is a short fixed list, so rows grow by that factor only and each row is checked on its own.
    """
    points = sorted(float(g) for g in grid)
    spread = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(g) for g in points])))
    scored = score(model, spread, "_p").select(row_id, feature, "_p")
    previous = F.lag("_p").over(Window.partitionBy(row_id).orderBy(feature))
    rise = (F.col("_p") - previous) if decreasing else (previous - F.col("_p"))
    per_row = scored.withColumn("_rise", rise).groupBy(row_id).agg(F.max("_rise").alias("_rise"))
    return per_row.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("_rise") > 1e-12).alias("n_violating"),
        F.max("_rise").alias("worst_rise"),
    )


def monotone_scores(
    model: PipelineModel, df: DataFrame, feature: str, grid: Sequence[float], row_id: str, name: str = "p_lead"
) -> DataFrame:
    """Scores made non-increasing in one feature: the lowest score over the row's own and all smaller grid values."""
    points = F.array_sort(F.array(*[F.lit(float(g)) for g in grid]))
    own = F.col(feature).cast("double")
    reach = F.array_union(F.filter(points, lambda g: g <= own), F.array(own))
    spread = df.withColumn(feature, F.explode(reach))
    lowest = score(model, spread, "_p").groupBy(row_id).agg(F.min("_p").alias(name))
    return df.join(lowest, row_id)
