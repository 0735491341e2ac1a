"""Split-conformal thresholds, prediction sets and coverage, globally and per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.operators.ordered import quantile
from plumbline.session import stage


def check_alpha(alpha: float) -> float:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie strictly between 0 and 1: {alpha}")
    return alpha


def finite_sample_level(n: Column, alpha: float) -> Column:
    return F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1 - alpha)) / n)


def thresholds(scores: DataFrame, score: str, alpha: float = 0.10) -> DataFrame:
    """One row (n_rows, threshold) from calibration scores."""
    level = finite_sample_level(F.col("n_rows"), check_alpha(alpha))
    return quantile(scores, score, level, name="threshold")


def group_thresholds(
    scores: DataFrame, score: str, group: str, groups: tuple = (1, 2, 3, 4), alpha: float = 0.10,
    min_rows: int = fv.MIN_GROUP_ROWS,
) -> DataFrame:
    """One row per listed group; a group with fewer than `min_rows` scores takes the global threshold."""
    level = finite_sample_level(F.col("n_rows"), check_alpha(alpha))
    # every row counts for its group and for the whole table, so that one pass gives both
    twice = scores.select(score, group, F.explode(F.array(F.lit(False), F.lit(True))).alias("_whole"))
    twice = twice.withColumn(group, F.when(~F.col("_whole"), F.col(group)))
    found = stage(quantile(twice, score, level, ["_whole", group], "_own"))
    own = found.where("NOT _whole").drop("_whole")
    overall = found.where("_whole").select("_own").scalar()
    kind = scores.schema[group].dataType.simpleString()
    listed = scores.sparkSession.createDataFrame([(g,) for g in groups], f"{group} {kind}")
    joined = listed.join(own, group, "left")
    n = F.coalesce("n_rows", F.lit(0))
    used = F.when(n >= min_rows, F.col("_own")).otherwise(overall)
    return joined.select(group, n.alias("n_rows"), used.alias("threshold"))


def prediction_set(p: Column, threshold: Column, labels: tuple[str, str] = fv.SET_LABELS) -> Column:
    """Labels not ruled out; an empty set falls back to the likelier label (the first one on a tie).

    A null probability has no set. A null threshold means the predictor was never calibrated and stops the job.
    """
    negative, positive = labels
    entries = F.array_compact(
        F.array(F.when(p <= threshold, F.lit(negative)), F.when(F.lit(1.0) - p <= threshold, F.lit(positive)))
    )
    likelier = F.when(p > F.lit(1.0) - p, F.lit(positive)).otherwise(F.lit(negative))
    chosen = F.when(F.size(entries) > 0, entries).otherwise(F.array(likelier))
    uncalibrated = F.raise_error(F.lit("prediction sets need a calibrated threshold")).cast("array<string>")
    return F.when(threshold.isNull(), uncalibrated).when(p.isNotNull(), chosen)


def raw_set_size(p: Column, threshold: Column) -> Column:
    """Labels within the threshold, without the fallback."""
    near = F.lit(1.0) - threshold
    return (p >= near).cast("int") + (F.lit(1.0) - p >= near).cast("int")


def with_threshold(df: DataFrame, table: DataFrame, group: str, first_group: object = 1) -> DataFrame:
    """Attach each row's group threshold; an unseen group takes that of `first_group`."""
    fallback = table.where(F.col(group) == first_group).select("threshold").scalar()
    joined = df.join(table.select(group, "threshold"), group, "left")
    return joined.withColumn("threshold", F.coalesce("threshold", fallback))


def coverage(df: DataFrame, score: str, p: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose true label is in the set, and mean set size with and without the fallback.

    Expects a `threshold` column.
    """
    t = F.col("threshold")
    size = raw_set_size(F.col(p), t)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col(score) <= t).cast("double")).alias("coverage"),
        F.avg(size.cast("double")).alias("mean_set_size"),
        F.avg(F.greatest(size, F.lit(1)).cast("double")).alias("mean_served_size"),
    )
