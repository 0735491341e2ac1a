"""Imputation values fitted on one table and applied to another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.ordered import quantile

MEDIANS = ("year_built", "lot_size_sqft", "building_sqft")
MODE = "stories"


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians as one row. The columns are counted together in long form, one row per distinct value."""
    cells = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]
    long = df.select(F.inline(F.array(*cells)))
    middle = quantile(long, "_v", F.lit(0.5), ["_c"], "_m")
    return middle.agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(c) for c in columns])


def mode(df: DataFrame, column: str, default: float = 1.0) -> DataFrame:
    """Most frequent value, the smallest on ties, `default` when there is none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).count()
    first = F.min_by("_v", F.struct(-F.col("count"), F.col("_v")))
    return counts.agg(F.coalesce(first, F.lit(default)).alias(column))


def fit(df: DataFrame, median_columns: Sequence[str] = MEDIANS, mode_column: str | None = MODE) -> DataFrame:
    """One row of fill values."""
    wanted = [c for c in median_columns if c in df.columns]
    out = medians(df, wanted) if wanted else df.sparkSession.range(1).select()
    if mode_column and mode_column in df.columns:
        out = out.withColumn(mode_column, mode(df, mode_column).scalar())
    return out


def apply(
    df: DataFrame, fitted: DataFrame, falses: Sequence[str] = ("has_basement",), unknowns: Sequence[str] = ("property_class",)
) -> DataFrame:
    """Fill nulls from the fitted row; booleans become false, categories become 'Unknown'."""
    out: dict[str, Column] = {}
    if fitted.columns:
        values = fitted.select(F.struct("*").alias("_v")).scalar()
        for c in fitted.columns:
            if c in df.columns:
                out[c] = F.coalesce(F.col(c).cast("double"), values.getField(c))
    out |= {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in falses if c in df.columns}
    out |= {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in unknowns if c in df.columns}
    return df.withColumns(out)
