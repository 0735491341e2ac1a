"""Shares of risk against shares of inspections, and error rates across groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.scores import clip
from plumbline.operators.ordered import quantile


def equity_boost(
    predictions: DataFrame, inspections: DataFrame, area: str = "census_tract", p: str = "p_lead",
    epsilon: float = 1e-6, name: str = "equity_boost", count: str | None = None,
) -> DataFrame:
    """(area, boost): how far an area's share of inspections lags behind its share of risk, in [0, 1].

    `inspections` holds one row per inspection, or totals per area in the column `count`. Both sides are
    aggregated per area before they meet, so the join never sees single rows.
    """
    times = F.sum(count) if count else F.count("*")
    risk = predictions.where(F.col(area).isNotNull()).groupBy(area).agg(F.sum(p).alias("_risk"))
    seen = inspections.groupBy(area).agg(times.alias("_seen"))
    # every prediction row counts towards the overall risk, every inspection towards the overall count
    all_risk = predictions.agg(F.coalesce(F.sum(p), F.lit(0.0))).scalar()
    all_seen = inspections.agg(F.coalesce(times, F.lit(0))).scalar()
    joined = risk.join(seen, area, "left").select(
        area, "_risk", F.coalesce("_seen", F.lit(0)).alias("_seen"), all_risk.alias("_all"), all_seen.alias("_n")
    )
    target = F.col("_risk") / F.nullif("_all", F.lit(0.0))
    actual = F.coalesce(F.col("_seen") / F.nullif("_n", F.lit(0)), F.lit(0.0))
    boost = clip((target - actual) / F.greatest(target, F.lit(epsilon)), 0.0, 1.0)
    return joined.select(area, F.when(F.col("_all") == 0, 0.0).otherwise(boost).alias(name))


def quartiles(df: DataFrame, value: str, name: str = "income_quartile") -> DataFrame:
    """Label 1..4 by linear-interpolation quartile edges, closed on the right; repeated edges raise."""
    values = df.where(F.col(value).isNotNull())
    edges = quantile(values, value, [F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)], name="_e")
    repeated = F.size(F.array_distinct("_e")) < 5
    checked = edges.select(
        F.when(repeated, F.raise_error(F.lit("quartile edges must be unique")).cast("array<double>")).otherwise(F.col("_e"))
    ).scalar()
    v = F.col(value)
    label = (
        F.when(v <= checked.getItem(1), 1).when(v <= checked.getItem(2), 2).when(v <= checked.getItem(3), 3).otherwise(4)
    )
    return values.withColumn(name, label)


def with_quartile(df: DataFrame, reference: DataFrame, area: str = "census_tract", name: str = "income_quartile", missing: int = fv.MISSING_QUARTILE) -> DataFrame:
    joined = df.join(reference.select(area, name), area, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(missing)))


def false_negatives(df: DataFrame, y: str, p: str, group: str, groups: tuple = (1, 2, 3, 4), threshold: float = fv.DECISION_THRESHOLD) -> DataFrame:
    """Per listed group: positives, misses and miss rate (NaN without positives)."""
    positive, missed = F.col(y) == 1, (F.col(y) == 1) & (F.col(p) < threshold)
    counts = df.groupBy(group).agg(F.count_if(positive).alias("n_pos"), F.count_if(missed).alias("n_missed"))
    kind = df.schema[group].dataType.simpleString()
    listed = df.sparkSession.createDataFrame([(g,) for g in groups], f"{group} {kind}")
    out = listed.join(counts, group, "left").na.fill(0, ["n_pos", "n_missed"])
    fnr = F.when(F.col("n_pos") > 0, F.col("n_missed") / F.nullif("n_pos", F.lit(0))).otherwise(float("nan"))
    return out.withColumn("fnr", fnr)


def disparity(rates: DataFrame, limit: float = fv.DISPARITY_LIMIT) -> DataFrame:
    """Spread of the defined miss rates and whether it exceeds the limit."""
    r = F.when(~F.isnan("fnr"), F.col("fnr"))
    spread = F.when(F.count(r) > 1, F.max(r) - F.min(r)).otherwise(0.0)
    return rates.agg(spread.alias("disparity")).withColumn("flagged", F.col("disparity") > limit)
