"""Equity, fairness audit, priority, queue, attribution arrays and the acquisition curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scores import ambiguity, is_positive, priority
from plumbline.models.pipelines import LABEL
from plumbline.operators import conformal as C, equity, explain
from plumbline.operators.queue import budget_queue, budget_queue_variable
from plumbline.plans import audit, scoring
from plumbline.plans.backtest import curve_from_rounds
from plumbline.queries.common import LOG, PROPERTY, inspection_log, known, mixed, mixed_sql, properties, query, r6, table
from plumbline.queries.evaluation import SCORES, scored, threshold_sql
from plumbline.queries.sources import INCOME, income_csv
from plumbline.sources.files import read_income

BOOST = f"""risk AS (SELECT census_tract, sum(p_lead) AS r FROM property GROUP BY census_tract),
  seen AS (SELECT census_tract, count(*) AS k FROM log GROUP BY census_tract),
  tot AS (SELECT (SELECT sum(p_lead) FROM property) AS rr, (SELECT count(*) FROM log) AS kk),
  boost AS (SELECT census_tract, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (r/rr - coalesce(k, 0)/kk)/greatest(r/rr, 1e-6::DOUBLE))) AS equity_boost
    FROM risk LEFT JOIN seen USING (census_tract) CROSS JOIN tot)"""


@query("f4_equity_boost", f"WITH {PROPERTY}, {LOG}, {BOOST} SELECT census_tract, round(equity_boost, 6) AS equity_boost FROM boost")
def f4(spark, sf):
    out = equity.equity_boost(properties(spark, sf), inspection_log(spark, sf))
    return out.select("census_tract", r6(F.col("equity_boost"), "equity_boost"))


@query("f4_equity_boost_no_inspections", f"WITH {PROPERTY} SELECT DISTINCT census_tract, CAST(1 AS DOUBLE) AS equity_boost FROM property WHERE census_tract IN (SELECT census_tract FROM property GROUP BY census_tract HAVING sum(p_lead) > 0)")
def f4_none(spark, sf):
    none = inspection_log(spark, sf).where("inspected_material = 'Wood'")
    risky = properties(spark, sf).groupBy("census_tract").agg(F.sum("p_lead").alias("p_lead")).where("p_lead > 0")
    return equity.equity_boost(risky, none)


@query("f4_equity_boost_no_risk", f"WITH {PROPERTY} SELECT DISTINCT census_tract, CAST(0 AS DOUBLE) AS equity_boost FROM property")
def f4_zero(spark, sf):
    calm = properties(spark, sf).withColumn("p_lead", F.lit(0.0))
    return equity.equity_boost(calm, inspection_log(spark, sf))


QUARTILES = """t AS (SELECT concat('17031', lpad(CAST(c_custkey%100 AS VARCHAR), 6, '0')) AS census_tract, avg(c_acctbal) AS income FROM customer GROUP BY 1),
  e AS (SELECT quantile_cont(income, 0.25) AS a, quantile_cont(income, 0.5) AS b, quantile_cont(income, 0.75) AS c FROM t),
  ref AS (SELECT census_tract, CASE WHEN income <= a THEN 1 WHEN income <= b THEN 2 WHEN income <= c THEN 3 ELSE 4 END AS income_quartile FROM t CROSS JOIN e)"""


def reference(spark, sf):
    tract = F.concat(F.lit("17031"), F.lpad((F.col("c_custkey") % 100).cast("string"), 6, "0"))
    incomes = table(spark, sf, "customer").groupBy(tract.alias("census_tract")).agg(F.avg("c_acctbal").alias("income"))
    return equity.quartiles(incomes, "income").select("census_tract", "income_quartile")


@query("f8_quartiles", f"WITH {QUARTILES} SELECT census_tract, income_quartile FROM ref")
def f8(spark, sf):
    return reference(spark, sf)


@query(
    "k4_fairness_reference",
    f"""WITH {INCOME}, e AS (SELECT quantile_cont(income, 0.25) AS a, quantile_cont(income, 0.5) AS b, quantile_cont(income, 0.75) AS c FROM income)
      SELECT census_tract, CASE WHEN income <= a THEN 1 WHEN income <= b THEN 2 WHEN income <= c THEN 3 ELSE 4 END AS income_quartile FROM income CROSS JOIN e""",
)
def k4(spark, sf):
    return audit.fairness_reference(read_income(spark, income_csv(spark, sf)))


RATES = f"""rates AS (SELECT q AS income_quartile, coalesce(n_pos, 0) AS n_pos, coalesce(n_missed, 0) AS n_missed, CASE WHEN n_pos > 0 THEN n_missed/n_pos END AS fnr FROM (VALUES (1), (2), (3), (4)) v(q)
  LEFT JOIN (SELECT coalesce(income_quartile, 2) AS iq, count(*) FILTER (service_line_material = 'Lead') AS n_pos, count(*) FILTER (service_line_material = 'Lead' AND p_lead < 0.5) AS n_missed
    FROM property LEFT JOIN ref USING (census_tract) GROUP BY 1) ON iq = q)"""


def rates(spark, sf):
    rows = properties(spark, sf).withColumn("y", is_positive(F.col("service_line_material")))
    return equity.false_negatives(equity.with_quartile(rows, reference(spark, sf)), "y", "p_lead", "income_quartile")


@query("f9_fnr_by_quartile", f"WITH {PROPERTY}, {QUARTILES}, {RATES} SELECT income_quartile, n_pos, n_missed, round(fnr, 6) AS fnr FROM rates")
def f9(spark, sf):
    return rates(spark, sf).select("income_quartile", "n_pos", "n_missed", r6(F.nanvl("fnr", F.lit(None).cast("double")), "fnr"))


@query("f9_fnr_disparity", f"WITH {PROPERTY}, {QUARTILES}, {RATES} SELECT round(max(fnr) - min(fnr), 6) AS disparity, max(fnr) - min(fnr) > 0.05 AS flagged FROM rates")
def f9_disparity(spark, sf):
    return equity.disparity(rates(spark, sf)).select(r6(F.col("disparity"), "disparity"), "flagged")


@query("k11_fnr_table", f"WITH {PROPERTY}, {QUARTILES}, {RATES} SELECT income_quartile, round_even(fnr*100, 1) AS fnr_pct FROM rates WHERE fnr IS NOT NULL")
def k11(spark, sf):
    return audit.fnr_table(rates(spark, sf))


@query(
    "k5_fairness_audit",
    f"""WITH {PROPERTY}, {LOG}, {BOOST}, {QUARTILES}, {RATES}
      SELECT (SELECT string_agg(concat(income_quartile, '=', CAST(round(fnr, 4) AS VARCHAR)), ',' ORDER BY income_quartile) FROM rates) AS fnr, (SELECT round((max(fnr) - min(fnr))*100, 4) FROM rates) AS fnr_disparity_pp,
        (SELECT max(fnr) - min(fnr) > 0.05 FROM rates) AS disparity_flagged, (SELECT count(*) FROM property WHERE service_line_material IN ('Lead','Copper','Galvanized')) AS n_labeled_properties,
        (SELECT count(*) FROM property) AS n_properties_with_quartile, (SELECT round(sum(equity_boost), 4) FROM (SELECT equity_boost FROM boost ORDER BY census_tract LIMIT 10)) AS boost_sample_sum""",
)
def k5(spark, sf):
    report = audit.fairness_audit(properties(spark, sf), reference(spark, sf), inspection_log(spark, sf))
    entries = F.array_sort(F.map_entries("fnr_by_quartile"))
    shown = F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 4).cast("string")))
    total = F.aggregate(F.map_values("equity_boost_sample"), F.lit(0.0), lambda a, v: a + v)
    return report.select(
        F.array_join(shown, ",").alias("fnr"), F.round("fnr_disparity_pp", 4).alias("fnr_disparity_pp"), "disparity_flagged",
        "n_labeled_properties", "n_properties_with_quartile", F.round(total, 4).alias("boost_sample_sum"),
    )


AMB = "(1.0::DOUBLE - abs(2.0::DOUBLE*p_lead - 1.0::DOUBLE))"
PRIORITY = f"""ranked AS (SELECT p.*, coalesce(b.equity_boost, 0) AS eb, {AMB} AS u, 0.6::DOUBLE*p_lead + 0.25::DOUBLE*{AMB} + 0.15::DOUBLE*coalesce(b.equity_boost, 0) AS score
  FROM property p LEFT JOIN boost b USING (census_tract))"""


@query(
    "k1_priority_strategies",
    f"""WITH {PROPERTY}, {LOG}, {BOOST}, {PRIORITY} SELECT property_id, round(p_lead, 6) AS risk, round(u, 6) AS uncertainty,
      round((0.6::DOUBLE/0.85::DOUBLE)*p_lead + (0.25::DOUBLE/0.85::DOUBLE)*u, 6) AS risk_uncertainty, round(score, 6) AS risk_uncertainty_equity, CAST(0 AS DOUBLE) AS oracle FROM ranked""",
)
def k1(spark, sf):
    rows = scoring.with_priority(properties(spark, sf), inspection_log(spark, sf))
    p, u, e = F.col("p_lead"), F.col("uncertainty_score"), F.col("equity_boost")
    names = ("risk", "uncertainty", "risk_uncertainty", "risk_uncertainty_equity", "oracle")
    return rows.select("property_id", *[r6(priority(p, u, e, s), s) for s in names])


def threshold(spark, sf):
    return C.thresholds(scored(spark, sf), "score").select("threshold").scalar()


THRESHOLD = f"{SCORES}, th AS {threshold_sql('s')}"
SET = """CASE WHEN p_lead > threshold AND 1 - p_lead > threshold THEN CASE WHEN p_lead > 1 - p_lead THEN 'Lead' ELSE 'NotLead' END
  ELSE concat_ws(',', CASE WHEN p_lead <= threshold THEN 'NotLead' END, CASE WHEN 1 - p_lead <= threshold THEN 'Lead' END) END"""


@query(
    "k2_budget_queue",
    f"""WITH {PROPERTY}, {LOG}, {BOOST}, {PRIORITY}, {THRESHOLD}, q AS (SELECT *, row_number() OVER (ORDER BY score DESC, property_id) AS rank FROM ranked)
      SELECT rank, property_id, round(score, 4) AS priority_score, round(p_lead, 4) AS p_lead_calibrated, round(u, 4) AS uncertainty_score, {SET} AS conformal_set, CAST(500 AS DOUBLE) AS estimated_cost_usd
      FROM q CROSS JOIN th WHERE rank <= least(500, floor(100000/500))""",
)
def k2(spark, sf):
    out = scoring.priority_queue(properties(spark, sf), inspection_log(spark, sf), threshold(spark, sf))
    return out.withColumn("conformal_set", F.array_join("conformal_set", ","))


@query("k2_queue_totals", f"WITH {PROPERTY} SELECT CAST(100000 AS DOUBLE) AS budget_usd, count(*) AS total_properties_ranked, least(count(*), 200) AS properties_within_budget FROM property")
def k2_totals(spark, sf):
    return scoring.queue_totals(properties(spark, sf))


@query("g3_zero_cost_queue", f"WITH {PROPERTY}, q AS (SELECT property_id, row_number() OVER (ORDER BY p_lead DESC, property_id) AS rank FROM property) SELECT rank, property_id FROM q WHERE rank <= 50")
def g3_zero(spark, sf):
    return budget_queue(properties(spark, sf).select("property_id", "p_lead"), "p_lead", "property_id", 10.0, 50, 0.0).select("rank", "property_id")


@query(
    "g3_variable_cost_queue",
    f"""WITH {PROPERTY}, q AS (SELECT property_id, cost, row_number() OVER (ORDER BY p_lead DESC, property_id) AS rank FROM property),
      s AS (SELECT *, sum(cost) OVER (ORDER BY rank) AS spent FROM q WHERE rank <= 500)
      SELECT rank, property_id, round(spent, 2) AS spent_usd FROM s WHERE rank < coalesce((SELECT min(rank) FROM s WHERE spent > 60000), 1000000)""",
)
def g3(spark, sf):
    rows = properties(spark, sf).select("property_id", "p_lead", "cost")
    return budget_queue_variable(rows, "p_lead", "property_id", "cost", 60000.0).select("rank", "property_id", F.round("spent_usd", 2).alias("spent_usd"))


@query(
    "k3_prediction_records",
    f"""WITH {PROPERTY}, {LOG}, {BOOST}, {PRIORITY}, {THRESHOLD}
      SELECT property_id, round(p_lead, 4) AS p_lead_calibrated, {SET} AS conformal_set, CAST(0.9 AS DOUBLE) AS confidence_level, round(u, 4) AS uncertainty_score, round(score, 4) AS priority_score, 'v2' AS model_version
      FROM ranked CROSS JOIN th WHERE property_id IN (SELECT user_id FROM events)""",
)
def k3(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("property_id"))
    out = scoring.prediction_records(properties(spark, sf), inspection_log(spark, sf), threshold(spark, sf), wanted=wanted, strict=False)
    return out.drop("shap_top_features", "predicted_at").withColumn("conformal_set", F.array_join("conformal_set", ","))


@query(
    "k7_acquisition_curve",
    f"""WITH r AS (SELECT o_orderstatus AS strategy, CAST(year(o_orderdate) - 1995 AS INTEGER) AS round, count(*) AS gained, count(*) FILTER (o_orderpriority = '1-URGENT') AS hits FROM orders GROUP BY 1, 2),
      b AS (SELECT *, coalesce(sum(gained) OVER w, 0) AS n, coalesce(sum(hits) OVER w, 0) AS f FROM r WINDOW w AS (PARTITION BY strategy ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT round, strategy, CAST(n + 100 AS BIGINT) AS cumulative_inspections, CAST(n*500 AS DOUBLE) AS cumulative_cost_usd, CAST(f AS BIGINT) AS cumulative_discoveries,
        round(f/greatest(1, n), 6) AS discoveries_per_inspection, round(f/greatest(1.0, n*500), 8) AS discoveries_per_usd FROM b""",
)
def k7(spark, sf):
    rounds = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("strategy"), (F.year("o_orderdate") - 1995).alias("round")).agg(
        F.count("*").alias("gained"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("hits")
    )
    out = curve_from_rounds(rounds, 100, 500.0)
    return out.withColumns({"discoveries_per_inspection": F.round("discoveries_per_inspection", 6), "discoveries_per_usd": F.round("discoveries_per_usd", 8)})


@query(
    "k11_curve_rows",
    "SELECT o_orderstatus AS strategy, CAST(o_custkey AS BIGINT) AS cumulative_inspections, o_totalprice AS pr_auc_remaining FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL",
)
def k11_curve(spark, sf):
    curve = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("strategy"), F.col("o_custkey").alias("cumulative_inspections"), F.col("o_totalprice").alias("pr_auc_remaining"))
    return audit.curve_rows(curve, ("F", "O"))


WEIGHTS = {"year": -0.02, "size": 0.0003, "floors": 0.5, "base": 0.25}
VALUES = "SELECT property_id, CAST(1880 + (property_id*31)%125 AS DOUBLE) AS year, lot_size_sqft AS size, CAST(1 + property_id%3 AS DOUBLE) AS floors, CAST(property_id%5 AS DOUBLE) AS base FROM property"


def linear(spark, sf):
    k = F.col("property_id")
    rows = properties(spark, sf).select(
        "property_id", (1880 + (k * 31) % 125).cast("double").alias("year"), F.col("lot_size_sqft").alias("size"),
        (1 + k % 3).cast("double").alias("floors"), (k % 5).cast("double").alias("base"),
    )
    means = rows.agg(*[F.round(F.avg(c), 3).alias(c) for c in WEIGHTS]).first().asDict()
    return rows.withColumn("attributions", explain.linear_attributions(WEIGHTS, means))


LINEAR = f"""v AS ({VALUES}), m AS (SELECT round(avg(year), 3) AS my, round(avg(size), 3) AS ms, round(avg(floors), 3) AS mf, round(avg(base), 3) AS mb FROM v),
  a AS (SELECT property_id, 'year' AS feature, (year - my) * -0.02::DOUBLE AS c FROM v CROSS JOIN m UNION ALL SELECT property_id, 'size', (size - ms) * 0.0003::DOUBLE FROM v CROSS JOIN m
    UNION ALL SELECT property_id, 'floors', (floors - mf) * 0.5::DOUBLE FROM v CROSS JOIN m UNION ALL SELECT property_id, 'base', (base - mb) * 0.25::DOUBLE FROM v CROSS JOIN m)"""


@query("j16_linear_attributions", f"WITH {PROPERTY}, {LINEAR} SELECT property_id, feature, round(c, 5) + 0.0 AS contribution FROM a")
def j16(spark, sf):
    out = linear(spark, sf).select("property_id", F.inline("attributions"))
    return out.select("property_id", "feature", (F.round("contribution", 5) + 0.0).alias("contribution"))


@query(
    "j17_top_contributions",
    f"WITH {PROPERTY}, {LINEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY -abs(c), feature) AS nth FROM a) SELECT property_id, string_agg(feature, ',' ORDER BY nth) AS features FROM r WHERE nth <= 3 GROUP BY property_id",
)
def j17(spark, sf):
    best = explain.top_contributions(F.col("attributions"), 3)
    return linear(spark, sf).select("property_id", F.array_join(F.transform(best, lambda e: e["feature"]), ",").alias("features"))


@query(
    "k3_prediction_records_with_features",
    f"""WITH {PROPERTY}, {LINEAR}, {LOG}, {BOOST}, {PRIORITY}, {THRESHOLD},
      f AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY -abs(c), feature) AS nth FROM a),
      t AS (SELECT property_id, string_agg(feature, ',' ORDER BY nth) AS top_features FROM f GROUP BY property_id)
      SELECT property_id, round(p_lead, 4) AS p_lead_calibrated, round(score, 4) AS priority_score, top_features
      FROM ranked JOIN t USING (property_id) WHERE property_id IN (SELECT user_id FROM events)""",
)
def k3_features(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("property_id"))
    rows = properties(spark, sf).join(linear(spark, sf).select("property_id", "attributions"), "property_id")
    out = scoring.prediction_records(rows, inspection_log(spark, sf), threshold(spark, sf), wanted=wanted, attributions="attributions", strict=False)
    top = F.array_join(F.transform("shap_top_features", lambda e: e["feature"]), ",")
    return out.select("property_id", "p_lead_calibrated", "priority_score", top.alias("top_features"))


@query(
    "a14_ranked_records",
    f"""WITH {PROPERTY}, {LINEAR}, {LOG}, {BOOST}, {PRIORITY}, {THRESHOLD},
      f AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY -abs(c), feature) AS nth FROM a),
      k AS (SELECT property_id, round(score, 4) AS priority_score, round(p_lead, 4) AS p_lead_calibrated, round(u, 4) AS uncertainty_score,
        replace({SET}, ',', ', ') AS conformal_set FROM ranked CROSS JOIN th WHERE property_id IN (SELECT user_id FROM events))
      SELECT row_number() OVER (ORDER BY priority_score DESC, property_id) AS rank, k.*, f.feature AS top_feature
      FROM k JOIN f USING (property_id) WHERE nth = 1""",
)
def a14_records(spark, sf):
    """Full records of an id list, ranked as they are shown."""
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("property_id"))
    rows = properties(spark, sf).join(linear(spark, sf).select("property_id", "attributions"), "property_id")
    out = scoring.prediction_records(rows, inspection_log(spark, sf), threshold(spark, sf), wanted=wanted, attributions="attributions", strict=False)
    return scoring.rank_ids(out)


@query("j18_global_importance", f"WITH {PROPERTY}, {LINEAR} SELECT feature, round(avg(abs(c)), 5) AS mean_abs FROM a GROUP BY feature")
def j18(spark, sf):
    out = explain.global_importance(linear(spark, sf), "attributions")
    return out.select("feature", F.round("mean_abs", 5).alias("mean_abs"))
