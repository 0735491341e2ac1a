"""Per-row attributions as arrays of (feature, contribution), and summaries of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def linear_attributions(weights: Mapping[str, float], means: Mapping[str, float]) -> Column:
    """Exact attributions of a linear score: weight * (value - mean)."""
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), ((F.col(c) - F.lit(float(means[c]))) * F.lit(float(w))).alias("contribution")
            )
            for c, w in weights.items()
        ]
    )


def top_contributions(attributions: Column, n: int = 5) -> Column:
    """The n largest by absolute value, largest first, ties by feature name; all of them when n is larger."""
    keyed = F.transform(
        attributions, lambda e: F.struct((-F.abs(e["contribution"])).alias("k"), e["feature"].alias("feature"), e["contribution"].alias("contribution"))
    )
    best = F.slice(F.array_sort(keyed), 1, n)
    return F.transform(best, lambda e: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution")))


def global_importance(df: DataFrame, attributions: str) -> DataFrame:
    """Mean absolute contribution per feature over all rows."""
    parts = df.select(F.inline(attributions))
    return parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def importance_table(spark, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
