"""Sigmoid calibration of a raw score."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F


def fit_sigmoid(df: DataFrame, score: str, y: str, weight: str | None = None) -> tuple[float, float]:
    """(slope, intercept) with smoothed targets.

    Positives aim at (n+ + 1) / (n+ + 2), negatives at 1 / (n- + 2). A soft target is the same likelihood as
    two weighted rows, one per class, which plain logistic regression can fit. With `weight` rows count by it.
    """
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    total = lambda label: F.coalesce(F.sum(F.when(F.col(y) == label, own)), F.lit(0.0))
    n_pos, n_neg = df.agg(total(1), total(0)).first()
    target = F.when(F.col(y) == 1, F.lit((n_pos + 1.0) / (n_pos + 2.0))).otherwise(F.lit(1.0 / (n_neg + 2.0)))
    both = F.array(
        F.struct(F.lit(1.0).alias("t"), (target * own).alias("w")), F.struct(F.lit(0.0).alias("t"), ((1 - target) * own).alias("w"))
    )
    rows = df.select(F.col(score).cast("double").alias("s"), F.inline(both))
    rows = VectorAssembler(inputCols=["s"], outputCol="x").transform(rows)
    fitted = LogisticRegression(
        featuresCol="x", labelCol="t", weightCol="w", regParam=0.0, standardization=False, maxIter=200, tol=1e-10
    ).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def apply_sigmoid(score: Column, slope: float, intercept: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * score + F.lit(intercept))))
