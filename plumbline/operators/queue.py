"""Ranking under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.ordered import top_k

MAX_QUEUE = 10_000


def affordable(budget: float, cost: float, limit: int) -> int:
    """Rows a constant cost allows; a zero cost leaves only the limit."""
    if budget < 0 or cost < 0 or not 1 <= limit <= MAX_QUEUE:
        raise ValueError("budget and cost must not be negative, limit must lie in 1..10000")
    return limit if cost == 0 else min(limit, int(budget // cost))


def budget_queue(df: DataFrame, score: str, row_id: str, budget: float, limit: int = 500, cost: float = 500.0) -> DataFrame:
    """Best-scored rows the budget pays for, ranked; a top-k plan, never a full sort."""
    best = top_k(df, [F.desc(score), F.asc(row_id)], affordable(budget, cost, limit))
    return best.withColumn("estimated_cost_usd", F.lit(float(cost)))


def budget_queue_variable(df: DataFrame, score: str, row_id: str, cost: str, budget: float, limit: int = 500) -> DataFrame:
    """The same with a cost per row: the queue stops at the first row the remaining budget cannot pay."""
    affordable(budget, 0.0, limit)
    best = top_k(df, [F.desc(score), F.asc(row_id)], limit)
    # at most `limit` rows from here on
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = best.withColumn("spent_usd", F.sum(cost).over(upto))
    stopped = F.max((F.col("spent_usd") > budget).cast("int")).over(upto)
    return spent.withColumn("_stop", stopped).where("_stop = 0").drop("_stop")
