"""Metrics, order statistics, conformal sets and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scores import is_positive, nonconformity
from plumbline.operators import conformal as C, equity, metrics as M
from plumbline.operators.ordered import quantile
from plumbline.plans.train import conformal_report
from plumbline.queries.common import (
    KNOWN, LINE_SCORES, ORDER_SCORES, PROPERTY, known, line_scores, order_scores, properties, query, r6, table,
)

GROUPED = """g AS (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM scores GROUP BY p),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, (SELECT sum(pos) FROM g) AS np, (SELECT sum(n) FROM g) AS nn FROM g WINDOW w AS (ORDER BY p DESC))"""
AP = "sum(pos * tp / seen) / max(np)"
ROC = "sum((n - pos) * (tp - pos + pos/2)) / max(np * (nn - np))"


@query("i9_average_precision", f"WITH {LINE_SCORES}, {GROUPED} SELECT round({AP}, 6) AS pr_auc FROM c")
def i9(spark, sf):
    return M.profile_metrics(M.score_profile(line_scores(spark, sf), "y", "p")).select(r6(F.col("pr_auc"), "pr_auc"))


@query("i10_roc_auc", f"WITH {LINE_SCORES}, {GROUPED} SELECT round({ROC}, 6) AS roc_auc FROM c")
def i10(spark, sf):
    return M.profile_metrics(M.score_profile(line_scores(spark, sf), "y", "p")).select(r6(F.col("roc_auc"), "roc_auc"))


@query(
    "i9_metrics_by_group",
    f"""WITH {LINE_SCORES}, g AS (SELECT part, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM scores GROUP BY part, p),
      t AS (SELECT part, sum(pos) AS np, sum(n) AS nn FROM g GROUP BY part),
      c AS (SELECT g.*, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, np, nn FROM g JOIN t USING (part) WINDOW w AS (PARTITION BY part ORDER BY p DESC))
      SELECT part, round({AP}, 6) AS pr_auc, round({ROC}, 6) AS roc_auc FROM c GROUP BY part""",
)
def i9_group(spark, sf):
    out = M.profile_metrics(M.score_profile(line_scores(spark, sf), "y", "p", ["part"]), by=["part"])
    return out.select("part", r6(F.col("pr_auc"), "pr_auc"), r6(F.col("roc_auc"), "roc_auc"))


@query(
    "i11_f2",
    f"WITH {LINE_SCORES}, k AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM scores) SELECT round(CASE WHEN 5*tp+4*fn+fp > 0 THEN 5*tp/(5*tp+4*fn+fp) ELSE 0 END, 6) AS f2 FROM k",
)
def i11(spark, sf):
    return M.threshold_metrics(line_scores(spark, sf), "y", "p").select(r6(F.col("f2"), "f2"))


@query("i12_brier", f"WITH {LINE_SCORES} SELECT round(avg((p-y)*(p-y)), 6) AS brier_score FROM scores")
def i12(spark, sf):
    return M.threshold_metrics(line_scores(spark, sf), "y", "p").select(r6(F.col("brier_score"), "brier_score"))


@query(
    "i9_metrics_by_group_with_nulls",
    f"""WITH {LINE_SCORES}, n AS (SELECT y, CASE WHEN p < 0.05 THEN NULL ELSE p END AS p, CASE WHEN p > 0.5 THEN part END AS part FROM scores),
      g AS (SELECT part, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM n GROUP BY part, p),
      t AS (SELECT part, sum(pos) AS np, sum(n) AS nn FROM g GROUP BY part),
      c AS (SELECT g.*, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, np, nn FROM g JOIN t ON g.part IS NOT DISTINCT FROM t.part WINDOW w AS (PARTITION BY g.part ORDER BY p DESC NULLS LAST))
      SELECT part, round({AP}, 6) AS pr_auc, round({ROC}, 6) AS roc_auc FROM c GROUP BY part""",
)
def i9_nulls(spark, sf):
    """Null scores rank last, and rows of no group are a group."""
    p = F.col("p")
    rows = line_scores(spark, sf).withColumns({"part": F.when(p > 0.5, F.col("part")), "p": F.when(p >= 0.05, p)})
    out = M.profile_metrics(M.score_profile(rows, "y", "p", ["part"]), by=["part"])
    return out.select("part", r6(F.col("pr_auc"), "pr_auc"), r6(F.col("roc_auc"), "roc_auc"))


RECALL = "SELECT sum(y) FILTER (rk <= greatest(1, floor(n*0.2::DOUBLE))) / sum(y) FROM (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS rk, count(*) OVER () AS n FROM scores)"


@query("i13_recall_at_budget", f"WITH {ORDER_SCORES} SELECT round(({RECALL}), 6) AS recall")
def i13(spark, sf):
    return M.recall_at_share(order_scores(spark, sf), "y", "p", "id").select(r6(F.col("recall"), "recall"))


@query(
    "i14_metrics_long_form",
    f"""WITH {ORDER_SCORES}, {GROUPED}, m AS (SELECT {AP} AS pr_auc, {ROC} AS roc_auc FROM c),
      k AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, avg((p-y)*(p-y)) AS b FROM scores)
      SELECT 'test_eval_pr_auc' AS metric, round(pr_auc, 6) AS value FROM m UNION ALL SELECT 'test_eval_roc_auc', round(roc_auc, 6) FROM m
      UNION ALL SELECT 'test_eval_f2', round(5*tp/(5*tp+4*fn+fp), 6) FROM k UNION ALL SELECT 'test_eval_brier_score', round(b, 6) FROM k
      UNION ALL SELECT 'test_eval_recall_at_20pct', round(({RECALL}), 6)""",
)
def i14(spark, sf):
    out = M.long_form(M.compute_metrics(order_scores(spark, sf), "y", "p", "id"), prefix="test_eval_")
    return out.select("metric", r6(F.col("value"), "value"))


@query(
    "i15_leakage_gap",
    f"""WITH {PROPERTY}, m AS (SELECT ward, avg(p_lead) AS rnd, avg(CASE WHEN service_line_material = 'Lead' THEN p_lead ELSE 0 END) AS geo FROM property GROUP BY ward)
      SELECT ward, round(CASE WHEN geo <> 0 THEN (rnd-geo)/geo END, 6) AS gap, CASE WHEN geo = 0 THEN FALSE ELSE (rnd-geo)/geo <= 0.15 END AS gap_ok FROM m""",
)
def i15(spark, sf):
    rows = properties(spark, sf)
    hit = F.when(F.col("service_line_material") == "Lead", F.col("p_lead")).otherwise(0.0)
    m = rows.groupBy("ward").agg(F.avg("p_lead").alias("rnd"), F.avg(hit).alias("geo"))
    return M.leakage_gap(m, "rnd", "geo").select("ward", r6(F.col("gap"), "gap"), "gap_ok")


@query(
    "i16_improvement_gate",
    f"""WITH {PROPERTY}, m AS (SELECT ward, avg(p_lead) AS a, avg(CASE WHEN year_built < 1950 THEN 1.0 ELSE 0.0 END) AS b FROM property GROUP BY ward)
      SELECT ward, round((a-b)/greatest(b, 1e-9), 4) AS improvement, (a-b)/greatest(b, 1e-9) > 0.10 AS gate_met FROM m""",
)
def i16(spark, sf):
    old = F.avg(F.coalesce((F.col("year_built") < 1950).cast("double"), F.lit(0.0)))
    m = properties(spark, sf).groupBy("ward").agg(F.avg("p_lead").alias("a"), old.alias("b"))
    out = M.improvement_gate(m, "a", "b")
    return out.select("ward", (F.round("improvement", 4) + F.lit(0.0)).alias("improvement"), "gate_met")


@query(
    "f11_class_balance",
    "SELECT l_shipdate >= TIMESTAMP '1999-01-01' AS late, count(*) FILTER (l_returnflag <> 'R') AS n_neg, count(*) FILTER (l_returnflag = 'R') AS n_pos, round(count(*) FILTER (l_returnflag <> 'R')/count(*) FILTER (l_returnflag = 'R'), 6) AS scale_pos_weight FROM lineitem GROUP BY 1",
)
def f11(spark, sf):
    late = F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")
    rows = table(spark, sf, "lineitem").select(late.alias("late"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return M.class_balance(rows, "y", ["late"]).withColumn("scale_pos_weight", F.round("scale_pos_weight", 6))


@query(
    "f14_fold_summary",
    """WITH r AS (SELECT c_nationkey%5 AS fold, c_mktsegment AS feature_set, CASE WHEN c_custkey%2 = 0 THEN 'boosted' ELSE 'heuristic' END AS model, c_acctbal/10000 AS v FROM customer)
      SELECT feature_set, round(avg(v) FILTER (model = 'boosted'), 6) AS mean_boosted, round(avg(v) FILTER (model = 'heuristic'), 6) AS mean_heuristic,
        round(avg(v) FILTER (model = 'boosted') - avg(v) FILTER (model = 'heuristic'), 6) AS delta FROM r GROUP BY feature_set""",
)
def f14(spark, sf):
    model = F.when(F.col("c_custkey") % 2 == 0, "boosted").otherwise("heuristic")
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("feature_set"), model.alias("model"), (F.col("c_acctbal") / 10000).alias("v"))
    out = M.fold_summary(rows, "model", "v", "feature_set", "boosted", "heuristic")
    return out.select("feature_set", *[r6(F.col(c), c) for c in ("mean_boosted", "mean_heuristic", "delta")])


@query(
    "f7_quantile_at_level",
    "WITH x AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem), h AS (SELECT DISTINCT n, least(1.0::DOUBLE, ceil((n+1)*0.9::DOUBLE)/n)*(n-1) AS h FROM x) SELECT max(x.n) AS n_rows, round(max(v) FILTER (i = floor(h)) + (max(v) FILTER (i = ceil(h)) - max(v) FILTER (i = floor(h)))*(max(h) - floor(max(h))), 6) AS quantile FROM x CROSS JOIN h",
)
def f7(spark, sf):
    out = quantile(table(spark, sf, "lineitem"), "l_extendedprice", C.finite_sample_level(F.col("n_rows"), 0.10))
    return out.select("n_rows", r6(F.col("quantile"), "quantile"))


@query(
    "g7_cumulative_hits",
    f"WITH {LINE_SCORES}, {GROUPED} SELECT p AS score, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS rows, CAST(tp - pos AS BIGINT) AS pos_before, CAST(seen - n AS BIGINT) AS rows_before FROM c",
)
def g7(spark, sf):
    return M.score_profile(line_scores(spark, sf), "y", "p")


QUART = "(1 + CAST(ward AS INTEGER)%4)"
SCORES = f"""s AS (SELECT property_id, {QUART} AS income_quartile, CASE WHEN service_line_material = 'Lead' THEN 1 ELSE 0 END AS y, p_lead AS p,
  1 - CASE WHEN service_line_material = 'Lead' THEN p_lead ELSE 1 - p_lead END AS score, ward < 13 AS cal FROM property WHERE {KNOWN})"""


def threshold_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keep = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {keep}max(n) AS n, max(score) FILTER (i = floor(h)) + (max(score) FILTER (i = ceil(h)) - max(score) FILTER (i = floor(h)))*(max(h) - floor(max(h))) AS threshold
      FROM (SELECT *, least(1.0::DOUBLE, ceil((n+1)*0.9::DOUBLE)/n)*(n-1) AS h FROM (SELECT {keep}score, row_number() OVER ({part} ORDER BY score) - 1 AS i, count(*) OVER ({part}) AS n FROM {src})) {group})"""


def scored(spark, sf):
    y = is_positive(F.col("service_line_material"))
    return known(properties(spark, sf)).select(
        "property_id", (1 + F.col("ward") % 4).alias("income_quartile"), y.alias("y"), F.col("p_lead").alias("p"),
        nonconformity(y, F.col("p_lead")).alias("score"), (F.col("ward") < 13).alias("cal"),
    )


@query("j12_conformal_threshold", f"WITH {PROPERTY}, {SCORES}, cal AS (SELECT * FROM s WHERE cal) SELECT n AS n_rows, round(threshold, 6) AS threshold FROM {threshold_sql('cal')}")
def j12(spark, sf):
    return C.thresholds(scored(spark, sf).where("cal"), "score").select("n_rows", r6(F.col("threshold"), "threshold"))


@query(
    "j13_prediction_sets",
    f"""WITH {PROPERTY}, {SCORES}, t AS {threshold_sql('s')},
      z AS (SELECT property_id, p, CASE WHEN p <= threshold THEN 'NotLead' END AS a, CASE WHEN 1 - p <= threshold THEN 'Lead' END AS b FROM s CROSS JOIN t)
      SELECT property_id, CASE WHEN a IS NULL AND b IS NULL THEN CASE WHEN p > 1 - p THEN 'Lead' ELSE 'NotLead' END ELSE concat_ws(',', a, b) END AS labels FROM z""",
)
def j13(spark, sf):
    rows = scored(spark, sf)
    t = C.thresholds(rows, "score").select("threshold").scalar()
    return rows.select("property_id", F.array_join(C.prediction_set(F.col("p"), t), ",").alias("labels"))


MONDRIAN = f"""own AS {threshold_sql('cal', 'income_quartile')}, overall AS {threshold_sql('cal')},
  mt AS (SELECT q AS income_quartile, coalesce(own.n, 0) AS n, CASE WHEN coalesce(own.n, 0) >= 5 THEN own.threshold ELSE overall.threshold END AS threshold
    FROM (VALUES (1), (2), (3), (4), (5)) v(q) LEFT JOIN own ON own.income_quartile = q CROSS JOIN overall)"""


@query(
    "j14_group_thresholds",
    f"WITH {PROPERTY}, {SCORES}, cal AS (SELECT * FROM s WHERE cal), {MONDRIAN} SELECT income_quartile, n AS n_rows, round(threshold, 6) AS threshold FROM mt",
)
def j14(spark, sf):
    out = C.group_thresholds(scored(spark, sf).where("cal"), "score", "income_quartile", (1, 2, 3, 4, 5))
    return out.select("income_quartile", "n_rows", r6(F.col("threshold"), "threshold"))


@query(
    "f10_coverage_by_group",
    f"""WITH {PROPERTY}, {SCORES}, cal AS (SELECT * FROM s WHERE cal), {MONDRIAN}
      SELECT income_quartile, count(*) AS n, round(avg(CASE WHEN score <= threshold THEN 1.0 ELSE 0.0 END), 6) AS coverage,
        round(avg(CAST(p >= 1 - threshold AS INTEGER) + CAST(1 - p >= 1 - threshold AS INTEGER)), 6) AS mean_set_size
      FROM s JOIN mt USING (income_quartile) WHERE NOT cal GROUP BY income_quartile""",
)
def f10(spark, sf):
    rows = scored(spark, sf)
    table_ = C.group_thresholds(rows.where("cal"), "score", "income_quartile")
    out = C.coverage(C.with_threshold(rows.where("not cal"), table_, "income_quartile"), "score", "p", ("income_quartile",))
    return out.select("income_quartile", "n", r6(F.col("coverage"), "coverage"), r6(F.col("mean_set_size"), "mean_set_size"))


@query(
    "j15_conformal_report",
    f"""WITH {PROPERTY}, {SCORES}, cal AS (SELECT * FROM s WHERE cal), {MONDRIAN}
      SELECT CAST(NULL AS INTEGER) AS income_quartile, count(*) AS n, round(avg(CASE WHEN score <= threshold THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(max(threshold), 6) AS threshold FROM s CROSS JOIN overall WHERE NOT cal
      UNION ALL SELECT income_quartile, count(*), round(avg(CASE WHEN score <= threshold THEN 1.0 ELSE 0.0 END), 6), round(max(threshold), 6) FROM s JOIN mt USING (income_quartile) WHERE NOT cal GROUP BY income_quartile""",
)
def j15(spark, sf):
    rows = scored(spark, sf)
    out = conformal_report(rows.where("cal"), rows.where("not cal"), "y", "p")
    return out.select("income_quartile", "n", r6(F.col("coverage"), "coverage"), r6(F.col("threshold"), "threshold"))
