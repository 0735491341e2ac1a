"""Classification metrics as aggregations over score groups.

Rows are collapsed to one per distinct score first (map-side combined), so ties are handled exactly and the
running counts that AP and ROC need go through `running_totals` instead of a one-task window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scores import clip
from plumbline.operators.ordered import global_rank, running_totals

NAN = float("nan")
METRICS = ("pr_auc", "roc_auc", "f2", "brier_score", "recall_at_20pct")


def score_profile(df: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per distinct score: positives, rows, and both before it in descending score order.

    With `weight` every row counts as much as its weight says (null: not at all); whole weights so give the profile of
    the rows repeated as often.
    """
    if weight is None:
        positives, rows = F.sum(F.col(y).cast("bigint")), F.count("*")
    else:
        w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
        positives, rows = F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)), F.sum(w)
    counts = df.groupBy(*by, F.col(p).alias("score")).agg(positives.alias("pos"), rows.alias("rows"))
    if weight is not None:
        counts = counts.where("rows > 0")
    return running_totals(counts, "score", ["pos", "rows"], by, descending=True)


def _f2(tp: Column, fp: Column, fn: Column) -> Column:
    below = 5 * tp + 4 * fn + fp
    return F.when(below > 0, 5 * tp / below).otherwise(0.0)


def profile_metrics(profile: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """AP, ROC-AUC, F2 and Brier score from a score profile; AP and ROC are NaN when one class is missing."""
    pos, rows, score = F.col("pos"), F.col("rows"), F.col("score")
    neg = rows - pos
    neg_before = F.col("rows_before") - F.col("pos_before")
    hit = score >= threshold
    sums = profile.groupBy(*by).agg(
        F.sum(rows).alias("n"),
        F.sum(pos).alias("n_pos"),
        F.sum(pos * (F.col("pos_before") + pos) / (F.col("rows_before") + rows)).alias("_ap"),
        F.sum(neg * (F.col("pos_before") + pos / 2)).alias("_auc"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("_fp"),
        F.sum(pos * (score - 1) * (score - 1) + neg * score * score).alias("_se"),
    )
    n, n_pos = F.col("n"), F.col("n_pos")
    n_neg = n - n_pos
    both = (n_pos > 0) & (n_neg > 0)
    # NULLIF guards the division itself: ANSI mode raises on a zero divisor
    zero = F.lit(0)
    return sums.select(
        *by,
        "n",
        "n_pos",
        F.when(both, F.col("_ap") / F.nullif(n_pos, zero)).otherwise(NAN).alias("pr_auc"),
        F.when(both, F.col("_auc") / F.nullif(n_pos * n_neg, zero)).otherwise(NAN).alias("roc_auc"),
        _f2(F.col("_tp"), F.col("_fp"), n_pos - F.col("_tp")).alias("f2"),
        (F.col("_se") / n).alias("brier_score"),
    )


def recall_at_share(df: DataFrame, y: str, p: str, row_id: str, share: float = 0.20, profile: DataFrame | None = None) -> DataFrame:
    """Recall within the best-scored `share` of rows (at least one row); ties at the edge go by id.

    Only the rows that share the edge score are ranked; everything above it comes from the profile.
    """
    profile = score_profile(df, y, p) if profile is None else profile
    sizes = profile.agg(F.sum("rows").alias("n"), F.sum("pos").alias("n_pos"))
    k = sizes.select(F.greatest(F.lit(1), F.floor(F.col("n") * share)).alias("k")).scalar()
    edge = profile.where((F.col("rows_before") < k) & (F.col("rows_before") + F.col("rows") >= k))
    edge_row = edge.select("score", "pos_before", (k - F.col("rows_before")).alias("room")).first()
    if edge_row is None:
        return sizes.select(F.lit(NAN).alias("recall"))
    tied = df.where(F.col(p) == edge_row["score"]).select(row_id, y)
    inside = global_rank(tied, [F.asc(row_id)], "_rank").where(F.col("_rank") <= edge_row["room"])
    extra = inside.agg(F.coalesce(F.sum(F.col(y).cast("bigint")), F.lit(0))).scalar()
    found = F.lit(edge_row["pos_before"]) + extra
    return sizes.select(F.when(F.col("n_pos") > 0, found / F.nullif("n_pos", F.lit(0))).otherwise(NAN).alias("recall"))


def threshold_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """F2 at a threshold and Brier score in one aggregation: neither needs an order."""
    hit, positive = F.col(p) >= threshold, F.col(y) == 1
    tp, fp, fn = F.count_if(hit & positive), F.count_if(hit & ~positive), F.count_if(~F.coalesce(hit, F.lit(False)) & positive)
    off = F.col(p) - F.col(y)
    sums = df.groupBy(*by).agg(tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"), (F.sum(off * off) / F.count("*")).alias("brier_score"))
    return sums.select(*by, _f2(F.col("_tp"), F.col("_fp"), F.col("_fn")).alias("f2"), "brier_score")


def weighted_recall_at_share(profile: DataFrame, share: float = 0.20) -> DataFrame:
    """Recall within the best-scored `share` of the total weight; of the score at the edge its part counts."""
    sizes = profile.agg(F.sum("rows").alias("n"), F.sum("pos").alias("n_pos"))
    room = sizes.select(F.col("n") * share).scalar()
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (room - F.col("rows_before")) / F.col("rows")))
    found = profile.agg(F.sum(F.col("pos") * part)).scalar()
    return sizes.select(F.when(F.col("n_pos") > 0, found / F.nullif("n_pos", F.lit(0.0))).otherwise(NAN).alias("recall"))


def compute_metrics(
    df: DataFrame, y: str, p: str, row_id: str, threshold: float = 0.5, share: float = 0.20, prefix: str = "", weight: str | None = None
) -> DataFrame:
    """All five metrics as one row. With `weight`, rows, positives and every sum count rows by it."""
    profile = score_profile(df, y, p, weight=weight)
    recall = recall_at_share(df, y, p, row_id, share, profile) if weight is None else weighted_recall_at_share(profile, share)
    out = profile_metrics(profile, threshold).withColumn("recall_at_20pct", recall.scalar())
    return out.select("n", "n_pos", *[F.col(m).alias(f"{prefix}{m}") for m in METRICS])


def long_form(metrics: DataFrame, names: Sequence[str] = METRICS, prefix: str = "") -> DataFrame:
    """One row per metric: (metric, value)."""
    entries = [F.struct(F.lit(f"{prefix}{m}").alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    return metrics.select(F.inline(F.array(*entries)))


def leakage_gap(metrics: DataFrame, random_value: str, held_out_value: str, limit: float = 0.15) -> DataFrame:
    """Relative excess of the random-split score over the held-out one, and whether it is acceptable."""
    held = F.col(held_out_value)
    gap = F.when(held != 0, (F.col(random_value) - held) / F.nullif(held, F.lit(0.0)))
    return metrics.withColumn("gap", gap).withColumn("gap_ok", F.coalesce(F.col("gap") <= limit, F.lit(False)))


def improvement_gate(metrics: DataFrame, new: str, base: str, minimum: float = 0.10) -> DataFrame:
    gain = (F.col(new) - F.col(base)) / F.greatest(F.col(base), F.lit(1e-9))
    return metrics.withColumn("improvement", gain).withColumn("gate_met", F.col("improvement") > minimum)


def class_balance(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Class counts and the weight that balances positives (1 when there are none)."""
    n_pos = F.count_if(F.col(y) == 1)
    n_neg = F.count_if(F.col(y) == 0)
    out = df.groupBy(*by).agg(n_neg.alias("n_neg"), n_pos.alias("n_pos"))
    weight = F.when(F.col("n_pos") > 0, F.col("n_neg") / F.nullif("n_pos", F.lit(0))).otherwise(1.0)
    return out.withColumn("scale_pos_weight", weight)


def fold_summary(results: DataFrame, model: str, value: str, group: str, first: str, second: str) -> DataFrame:
    """Mean of `value` per group for two models, and their difference."""
    mean = lambda name: F.avg(F.when(F.col(model) == name, F.col(value)))
    out = results.groupBy(group).agg(mean(first).alias(f"mean_{first}"), mean(second).alias(f"mean_{second}"))
    return out.withColumn("delta", F.col(f"mean_{first}") - F.col(f"mean_{second}"))


POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13))


def replicate_counts(
    df: DataFrame, y: str, p: str, row_id: str, replicates: int, seed: int = 42, key: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(_y, _p, replicate, _times): how often a row counts in each replicate, also where that is 0."""
    uniform = key or (lambda row, r: F.shiftrightunsigned(F.xxhash64(F.lit(seed), row, r), 11) / F.lit(float(1 << 53)))
    # the work is a hash per row and replicate, so it is dealt by cores and not by the few bytes that the rows take
    rows = df.select(F.col(y).alias("_y"), F.col(p).alias("_p"), F.col(row_id).alias("_row"))
    rows = rows.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    drawn = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.withColumn("_u", uniform(F.col("_row"), F.col("replicate")))
    # no filter on the count here: Spark would push it below `_u` and hash once for every bound
    times = F.when(F.col("_u") >= POISSON[-1], float(len(POISSON)))
    for k, (low, high) in enumerate(zip(POISSON, POISSON[1:]), 1):
        times = times.when((F.col("_u") >= low) & (F.col("_u") < high), float(k))
    return drawn.select("_y", "_p", "replicate", times.otherwise(0.0).alias("_times"))


def bootstrap_precision(
    df: DataFrame, y: str, p: str, row_id: str, replicates: int = 200, level: float = 0.95, seed: int = 42,
    key: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Average precision with its bootstrap interval: one row (pr_auc, low, high, n_replicates).

    In each replicate a row counts as often as a Poisson(1) number says, drawn from a hash of (row, replicate) - `key`
    gives a uniform number in [0, 1) instead - so no rows are drawn, reruns agree, and a replicate is a weighted
    score profile. All replicates share one pass: rows are collapsed per
    replicate and score before they are shuffled. Replicates in which a class is missing have no value and do not count.
    """
    counted = replicate_counts(df, y, p, row_id, replicates, seed, key)
    each = profile_metrics(score_profile(counted, "_y", "_p", ["replicate"], "_times"), by=["replicate"]).where(~F.isnan("pr_auc"))
    tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    interval = each.agg(F.percentile("pr_auc", tails).alias("_t"), F.count("*").alias("n_replicates"))
    whole = profile_metrics(score_profile(df, y, p)).select("pr_auc")
    return interval.select(whole.scalar().alias("pr_auc"), F.col("_t")[0].alias("low"), F.col("_t")[1].alias("high"), "n_replicates")


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = clip(F.col(p), eps, 1 - eps)
    return df.agg((-F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"))


def _bin(p: str, bins: int) -> Column:
    return clip(F.floor(F.col(p) * bins), 0, bins - 1).cast("int").alias("bin")


def reliability(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Per score bin: rows, mean score, observed rate and absolute gap."""
    out = df.groupBy(_bin(p, bins)).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed")
    )
    return out.withColumn("gap", F.abs(F.col("mean_score") - F.col("observed")))


def expected_calibration_error(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    r = reliability(df, y, p, bins)
    return r.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def population_stability(base: DataFrame, current: DataFrame, p: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Shift of a score distribution between two tables, per bin and as a sum over bins."""
    b = _bin(p, bins)
    counts = base.select(b, F.lit(0).alias("_s")).unionByName(current.select(b, F.lit(1).alias("_s")))
    per_bin = counts.groupBy("bin").agg(F.count_if(F.col("_s") == 0).alias("n_base"), F.count_if(F.col("_s") == 1).alias("n_current"))
    total = lambda c: F.greatest(per_bin.agg(F.sum(c)).scalar(), F.lit(1))
    e = F.greatest(F.lit(floor), F.col("n_base") / total("n_base"))
    a = F.greatest(F.lit(floor), F.col("n_current") / total("n_current"))
    return per_bin.withColumn("psi", (a - e) * F.log(a / e))
