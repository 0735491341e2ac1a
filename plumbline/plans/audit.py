"""Area reference table and the audit of error rates across its quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.scores import is_positive
from plumbline.operators.equity import disparity, equity_boost, false_negatives, quartiles, with_quartile
from plumbline.operators.ordered import top_k
from plumbline.operators.quality import FAIRNESS_REFERENCE, validate


def fairness_reference(incomes: DataFrame) -> DataFrame:
    """(census_tract, income_quartile) from (census_tract, income), validated."""
    labelled = quartiles(incomes.where("income > 0"), "income")
    return validate(labelled.select("census_tract", "income_quartile"), FAIRNESS_REFERENCE)


def fairness_audit(
    predictions: DataFrame, reference: DataFrame, inspections: DataFrame, label: str = "service_line_material",
    p: str = "p_lead", area: str = "census_tract", sample: int = 10,
) -> DataFrame:
    """One report row: miss rates by quartile, their spread, a sample of boosts and the row counts."""
    rows = with_quartile(predictions.withColumn("_y", is_positive(F.col(label))), reference, area)
    rates = false_negatives(rows, "_y", p, "income_quartile")
    spread = disparity(rates).select(F.struct("*")).scalar()
    by_quartile = rates.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("income_quartile").cast("string"), "fnr"))))
    ).scalar()
    boosts = equity_boost(predictions.select(area, p).dropna(), inspections, area, p)
    few = top_k(boosts, [F.asc(area)], sample)
    boost_sample = few.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(area, "equity_boost"))))).scalar()
    counts = rows.agg(
        F.count_if(F.col(label).isin(*fv.KNOWN_LABELS)).alias("n_labeled_properties"),
        F.count_if(F.col("income_quartile") > 0).alias("n_properties_with_quartile"),
    )
    return counts.select(
        by_quartile.alias("fnr_by_quartile"), (spread.getField("disparity") * 100).alias("fnr_disparity_pp"),
        spread.getField("flagged").alias("disparity_flagged"), boost_sample.alias("equity_boost_sample"),
        "n_labeled_properties", "n_properties_with_quartile",
    )


def fnr_table(rates: DataFrame) -> DataFrame:
    """Miss rates as percentages for display: undefined ones left out, in quartile order."""
    shown = rates.where(~F.isnan("fnr")).select("income_quartile", F.bround(F.col("fnr") * 100, 1).alias("fnr_pct"))
    return shown.orderBy("income_quartile")


def curve_rows(curve: DataFrame, strategies: tuple[str, ...] = ("uncertainty", "random"), value: str = "pr_auc_remaining") -> DataFrame:
    shown = curve.where(F.col("strategy").isin(*strategies) & F.col(value).isNotNull() & ~F.isnan(value))
    return shown.select("strategy", "cumulative_inspections", value).orderBy("strategy", "cumulative_inspections")
