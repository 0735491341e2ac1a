"""Replay of acquisition policies over historical labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.config import ScoringConfig, TrainConfig
from plumbline.functions.scores import is_positive, unit_hash
from plumbline.models import pipelines as ml
from plumbline.operators.metrics import profile_metrics, score_profile
from plumbline.operators.ordered import global_rank, hash_rank
from plumbline.plans.features import LABEL_FEATURES, label_features
from plumbline.plans.scoring import with_priority
from plumbline.session import stage

CURVE = (
    "round int, strategy string, cumulative_inspections bigint, cumulative_cost_usd double, cumulative_discoveries bigint, "
    "discoveries_per_inspection double, discoveries_per_usd double, pr_auc_remaining double"
)


def initial_labels(rows: DataFrame, row_id: str, fraction: float, seed: int = fv.SEED, key: Column | None = None) -> DataFrame:
    """Ids of the first fraction (at least one row) in hash order."""
    key = unit_hash(F.col(row_id), seed) if key is None else key
    ranked = hash_rank(rows.select(row_id), key, row_id, name="_rank")
    size = F.greatest(F.lit(1), F.floor(rows.agg(F.count("*")).scalar() * fraction))
    return ranked.where(F.col("_rank") <= size).select(row_id)


def acquire(pool: DataFrame, row_id: str, strategy: str, batch: int, seed: int, key: Column | None = None) -> DataFrame:
    """Ids and outcomes of the next batch. The oracle takes positives while there are any, else the first rows.

    The oracle's order is that of `key` (default: a hash of id and seed), ties by id.
    """
    if strategy != "oracle":
        return pool.orderBy(F.desc("priority_score"), F.asc(row_id)).limit(batch).select(row_id, ml.LABEL)
    order = unit_hash(F.col(row_id), seed) if key is None else key
    hits = pool.where(F.col(ml.LABEL) == 1)
    source = pool if hits.isEmpty() else hits
    return source.orderBy(order, row_id).limit(batch).select(row_id, ml.LABEL)


def back_test(
    base: DataFrame, row_id: str = "property_id", label: str = "service_line_material", area: str = "census_tract",
    strategies: Sequence[str] = fv.STRATEGIES, features: Sequence[str] = fv.FEATURE_SETS["intrinsic_geo"],
    cfg: ScoringConfig = ScoringConfig(), train: TrainConfig = TrainConfig(), exclude_self: bool = False, seed: int = fv.SEED,
) -> DataFrame:
    """The acquisition curve: one row per strategy and round.

    Each round rebuilds the label features from what is labelled so far, retrains, scores the pool, logs and
    acquires. Only counters and the average precision come to the driver; ids stay in staged tables, so the
    lineage is cut every round. Boosts use the currently labelled rows as inspections and are joined by area.
    """
    rows = stage(base.where(F.col(label).isin(*fv.KNOWN_LABELS)))
    total = rows.count()
    if not total:
        return base.sparkSession.createDataFrame([], CURVE)
    start = stage(initial_labels(rows, row_id, cfg.initial_labeled_fraction, seed))
    n_start = start.count()
    wanted = [f for f in features if f in LABEL_FEATURES]
    curve = []
    for strategy in strategies:
        known, n_known, found, cost = start, n_start, 0, 0.0
        for turn in range(cfg.n_rounds + 1):
            if n_known >= total:
                break
            marked = rows.join(known.withColumn("_known", F.lit(True)), row_id, "left")
            visible = rows.join(known, row_id, "left_semi")
            if wanted:
                marked = label_features(marked, visible, row_id, label, exclude_self=exclude_self, wanted=wanted)
            marked = stage(
                ml.training_matrix(marked.withColumn("_known", F.coalesce("_known", F.lit(False))), features, label, [row_id, area, "_known"])
            )
            model = ml.fit_boosted(marked.where("_known"), features, train)
            pool = stage(ml.score(model, marked.where("not _known")).select(row_id, area, ml.LABEL, "p_lead"))
            ap = profile_metrics(score_profile(pool, ml.LABEL, "p_lead")).first()["pr_auc"]
            curve.append(
                (turn, strategy, n_known, cost, found, found / max(1, n_known - n_start), found / max(1.0, cost), ap)
            )
            if turn == cfg.n_rounds:
                break
            scored = with_priority(
                pool, visible, area=area, strategy=strategy, cfg=cfg, key=row_id, seed=seed + turn
            )
            taken = stage(acquire(scored, row_id, strategy, cfg.batch_size, seed))
            gained, hits = taken.agg(F.count("*"), F.coalesce(F.sum(ml.LABEL), F.lit(0.0))).first()
            known = stage(known.unionByName(taken.select(row_id)))
            n_known, found, cost = n_known + gained, found + int(hits), cost + gained * cfg.cost_per_inspection
    return base.sparkSession.createDataFrame(curve, CURVE)


def curve_from_rounds(rounds: DataFrame, start: int, cost: float) -> DataFrame:
    """Curve columns from a table (strategy, round, gained, hits) of batches: totals before each round."""
    from plumbline.operators.history import cumulative

    before = cumulative(rounds, "round", ["gained", "hits"], ["strategy"])
    n, found = F.col("gained_before"), F.col("hits_before")
    spent = n * F.lit(float(cost))
    return before.select(
        "round", "strategy", (n + start).alias("cumulative_inspections"), spent.alias("cumulative_cost_usd"),
        found.alias("cumulative_discoveries"), (found / F.greatest(F.lit(1), n)).alias("discoveries_per_inspection"),
        (found / F.greatest(F.lit(1.0), spent)).alias("discoveries_per_usd"),
    )


def precision_at_budgets(df: DataFrame, y: str, score: str, row_id: str, budgets: Sequence[float], cost: float) -> DataFrame:
    """Share of positives among the rows each budget pays for; at no cost, every budget pays for all."""
    if cost < 0:
        raise ValueError(f"cost must not be negative: {cost}")
    sizes = [(float(b), int(b // cost) if cost else 2**62) for b in budgets]
    reach = F.explode(F.array(*[F.struct(F.lit(b).alias("budget_usd"), F.lit(k).alias("k")) for b, k in sizes]))
    ranked = global_rank(df.select(row_id, score, y), [F.desc(score), F.asc(row_id)])
    rows = ranked.withColumn("_b", reach).where(F.col("rank") <= F.col("_b.k"))
    return rows.groupBy(F.col("_b.budget_usd").alias("budget_usd")).agg(
        F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("precision")
    )
