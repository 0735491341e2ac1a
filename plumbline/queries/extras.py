"""Documented but unbuilt measures of the original: log loss, calibration bins, budget precision, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scores import example_weight
from plumbline.operators import metrics as M
from plumbline.plans.backtest import precision_at_budgets
from plumbline.queries.common import LINE_SCORES, ORDER_SCORES, line_scores, order_scores, query, r6

BIN = "CAST(least(9, floor(p*10)) AS INTEGER)"


@query("o1_log_loss", f"WITH {LINE_SCORES} SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(1e-15, least(1-1e-15, p))) ELSE ln(1 - greatest(1e-15, least(1-1e-15, p))) END), 6) AS log_loss FROM scores")
def o1(spark, sf):
    return M.log_loss(line_scores(spark, sf), "y", "p").select(r6(F.col("log_loss"), "log_loss"))


@query("o2_reliability", f"WITH {LINE_SCORES} SELECT {BIN} AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed FROM scores GROUP BY 1")
def o2(spark, sf):
    out = M.reliability(line_scores(spark, sf), "y", "p")
    return out.select("bin", "n", r6(F.col("mean_score"), "mean_score"), r6(F.col("observed"), "observed"))


@query("o2_calibration_error", f"WITH {LINE_SCORES}, b AS (SELECT {BIN} AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM scores GROUP BY 1) SELECT round(sum(n*gap)/sum(n), 6) AS ece FROM b")
def o2_ece(spark, sf):
    return M.expected_calibration_error(line_scores(spark, sf), "y", "p").select(r6(F.col("ece"), "ece"))


@query(
    "o3_precision_at_budgets",
    f"WITH {ORDER_SCORES}, r AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS rk FROM scores), b AS (SELECT * FROM (VALUES (100000.0, 200), (500000.0, 1000), (1000000.0, 2000)) v(budget, k)) SELECT CAST(budget AS DOUBLE) AS budget_usd, count(*) AS n, round(avg(y), 6) AS precision FROM r JOIN b ON rk <= k GROUP BY budget",
)
def o3(spark, sf):
    out = precision_at_budgets(order_scores(spark, sf), "y", "p", "id", (100000.0, 500000.0, 1000000.0), 500.0)
    return out.select("budget_usd", "n", r6(F.col("precision"), "precision"))


@query(
    "o4_score_drift",
    f"""WITH {LINE_SCORES}, c AS (SELECT {BIN} AS bin, count(*) FILTER (part = 'F') AS n_base, count(*) FILTER (part = 'O') AS n_current FROM scores GROUP BY 1),
      s AS (SELECT *, greatest(1e-4::DOUBLE, n_base/(SELECT sum(n_base) FROM c)) AS e, greatest(1e-4::DOUBLE, n_current/(SELECT sum(n_current) FROM c)) AS a FROM c)
      SELECT bin, n_base, n_current, round((a-e)*ln(a/e), 6) + 0.0 AS psi FROM s""",
)
def o4(spark, sf):
    rows = line_scores(spark, sf)
    out = M.population_stability(rows.where("part = 'F'"), rows.where("part = 'O'"), "p")
    return out.select("bin", "n_base", "n_current", r6(F.col("psi"), "psi"))


REPLICATES = 40
UNIFORM_SQL = "CAST(CAST('0x' || substr(md5(concat(id, ':', r)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
TIMES_SQL = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in M.POISSON)


@query(
    "o5_bootstrap_interval",
    f"""WITH {ORDER_SCORES}, d AS (SELECT r, y, p, {UNIFORM_SQL} AS u FROM scores, range(1, {REPLICATES + 1}) t(r)),
      w AS (SELECT r, y, p, {TIMES_SQL} AS times FROM d),
      g AS (SELECT r, p, CAST(sum(y * times) AS DOUBLE) AS pos, CAST(sum(times) AS DOUBLE) AS n FROM w WHERE times > 0 GROUP BY r, p),
      c AS (SELECT *, sum(pos) OVER k AS tp, sum(n) OVER k AS seen FROM g WINDOW k AS (PARTITION BY r ORDER BY p DESC)),
      a AS (SELECT r, sum(pos * tp / seen) / sum(pos) AS ap FROM c GROUP BY r),
      h AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, count(*) AS n FROM scores GROUP BY p),
      e AS (SELECT pos, sum(pos) OVER k AS tp, sum(n) OVER k AS seen FROM h WINDOW k AS (ORDER BY p DESC))
      SELECT round((SELECT sum(pos * tp / seen) / sum(pos) FROM e), 6) AS pr_auc, round(quantile_cont(ap, 0.025), 6) AS low, round(quantile_cont(ap, 0.975), 6) AS high, count(*) AS n_replicates FROM a""",
)
def o5(spark, sf):
    uniform = lambda row, r: F.conv(F.substring(F.md5(F.concat_ws(":", row, r)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out = M.bootstrap_precision(order_scores(spark, sf), "y", "p", "id", REPLICATES, key=uniform)
    return out.select(*[r6(F.col(c), c) for c in ("pr_auc", "low", "high")], "n_replicates")


@query(
    "o6_weighted_metrics",
    f"""WITH {LINE_SCORES}, x AS (SELECT y, p, CASE WHEN part = 'F' THEN 0.25::DOUBLE ELSE 1.5::DOUBLE END AS w FROM scores),
      g AS (SELECT p, sum(y * w) AS pos, sum(w) AS n FROM x GROUP BY p),
      c AS (SELECT *, sum(pos) OVER k AS tp, sum(n) OVER k AS seen, (SELECT sum(pos) FROM g) AS np, (SELECT sum(n) FROM g) AS nn FROM g WINDOW k AS (ORDER BY p DESC)),
      f AS (SELECT sum(w) FILTER (p >= 0.5 AND y = 1) AS tp, sum(w) FILTER (p >= 0.5 AND y = 0) AS fp, sum(w) FILTER (p < 0.5 AND y = 1) AS fn, sum(w * (p - y) * (p - y)) / sum(w) AS brier FROM x)
      SELECT round(max(nn), 3) AS n, round(max(np), 3) AS n_pos, round(sum(pos * tp / seen) / max(np), 6) AS pr_auc, round(sum((n - pos) * (tp - pos + pos / 2)) / max(np * (nn - np)), 6) AS roc_auc,
        (SELECT round(5 * tp / (5 * tp + 4 * fn + fp), 6) FROM f) AS f2, (SELECT round(brier, 6) FROM f) AS brier_score,
        round(sum(pos * greatest(0, least(1, (0.2 * nn - (seen - n)) / n))) / max(np), 6) AS recall_at_20pct FROM c""",
)
def o6(spark, sf):
    """Rows of one source count a quarter, those of the other one and a half."""
    rows = line_scores(spark, sf).withColumn("w", example_weight(F.col("part"), {"F": 0.25, "O": 1.5}))
    out = M.compute_metrics(rows, "y", "p", "id", weight="w")
    return out.select(F.round("n", 3).alias("n"), F.round("n_pos", 3).alias("n_pos"), *[r6(F.col(m), m) for m in M.METRICS])
