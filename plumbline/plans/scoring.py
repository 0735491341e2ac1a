"""Batch scoring: prediction records, the budget queue and id-list lookups, each as one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.config import ScoringConfig
from plumbline.functions.scores import ambiguity, priority, round4
from plumbline.operators.conformal import prediction_set
from plumbline.operators.equity import equity_boost
from plumbline.operators.explain import top_contributions
from plumbline.operators.lookup import restrict
from plumbline.operators.ordered import global_rank, top_k
from plumbline.operators.queue import affordable, budget_queue

QUEUE_COLUMNS = (
    "rank", "property_id", "priority_score", "p_lead_calibrated", "uncertainty_score", "conformal_set", "estimated_cost_usd",
)


def with_priority(
    df: DataFrame, inspections: DataFrame, p: str = "p_lead", area: str = "census_tract",
    strategy: str = "risk_uncertainty_equity", cfg: ScoringConfig = ScoringConfig(), key: str | None = None, seed: int = 42,
) -> DataFrame:
    """Add uncertainty, equity boost (0 where the area has none) and priority. The boost is computed once."""
    boosts = equity_boost(df.select(area, p), inspections, area, p, cfg.epsilon)
    out = df.join(boosts, area, "left").withColumn("equity_boost", F.coalesce("equity_boost", F.lit(0.0)))
    out = out.withColumn("uncertainty_score", ambiguity(F.col(p)))
    score = priority(
        F.col(p), F.col("uncertainty_score"), F.col("equity_boost"), strategy, cfg.lambda1, cfg.lambda2, cfg.lambda3,
        F.col(key) if key else None, seed,
    )
    return out.withColumn("priority_score", score)


def priority_queue(
    df: DataFrame, inspections: DataFrame, threshold: Column, row_id: str = "property_id", p: str = "p_lead",
    area: str = "census_tract", budget: float = 100_000.0, limit: int = 500, cost: float = 500.0,
    cfg: ScoringConfig = ScoringConfig(),
) -> DataFrame:
    """The ranked queue; only the listed columns leave, so no address can."""
    scored = with_priority(df.select(row_id, area, p), inspections, p, area, cfg=cfg)
    best = budget_queue(scored, "priority_score", row_id, budget, limit, cost)
    return best.select(
        "rank", F.col(row_id).alias("property_id"), round4(F.col("priority_score")).alias("priority_score"),
        round4(F.col(p)).alias("p_lead_calibrated"), round4(F.col("uncertainty_score")).alias("uncertainty_score"),
        prediction_set(F.col(p), threshold).alias("conformal_set"), "estimated_cost_usd",
    )


def queue_totals(df: DataFrame, budget: float = 100_000.0, limit: int = 500, cost: float = 500.0) -> DataFrame:
    """Budget, rows ranked and rows within the budget."""
    n = F.count("*")
    return df.agg(
        F.lit(float(budget)).alias("budget_usd"), n.alias("total_properties_ranked"),
        F.least(n, F.lit(affordable(budget, cost, limit))).alias("properties_within_budget"),
    )


def prediction_records(
    df: DataFrame, inspections: DataFrame, threshold: Column, row_id: str = "property_id", p: str = "p_lead",
    area: str = "census_tract", wanted: DataFrame | None = None, attributions: str | None = None,
    version: str = "v2", confidence: float = 0.90, cfg: ScoringConfig = ScoringConfig(), strict: bool = True,
) -> DataFrame:
    """One full record per (wanted) id. Shares use all rows, ids are restricted afterwards."""
    columns = [row_id, area, p, *([attributions] if attributions else [])]
    scored = with_priority(df.select(*columns), inspections, p, area, cfg=cfg)
    if wanted is not None:
        scored = restrict(scored, wanted, row_id, strict)
    top = top_contributions(F.col(attributions)) if attributions else F.array().cast("array<struct<feature:string,contribution:double>>")
    return scored.select(
        F.col(row_id).alias("property_id"), round4(F.col(p)).alias("p_lead_calibrated"),
        prediction_set(F.col(p), threshold).alias("conformal_set"), F.lit(confidence).alias("confidence_level"),
        round4(F.col("uncertainty_score")).alias("uncertainty_score"), round4(F.col("priority_score")).alias("priority_score"),
        top.alias("shap_top_features"), F.lit(version).alias("model_version"), F.current_timestamp().alias("predicted_at"),
    )


def rank_ids(records: DataFrame, limit: int | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Records of an id list, best first, as the dashboard shows them; all of them unless a report sets `limit`."""
    order = [F.desc("priority_score"), F.asc("property_id")]
    best = global_rank(records, order) if limit is None else top_k(records, order, limit)
    first = F.get(F.col("shap_top_features"), 0)["feature"]
    return best.select(
        "rank", "property_id", "priority_score", "p_lead_calibrated", "uncertainty_score",
        F.array_join("conformal_set", ", ").alias("conformal_set"), first.alias("top_feature"), *columns,
    )
