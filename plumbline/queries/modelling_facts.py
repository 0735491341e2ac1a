"""What holds of trained models whatever the fit: which rows are scored, and that numbers which must agree do."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from plumbline.models import pipelines as ml, staged, store
from plumbline.models.attributions import tree_attributions
from plumbline.models.calibration import apply_sigmoid, fit_sigmoid
from plumbline.operators.equity import quartiles
from plumbline.plans import train as T
from plumbline.queries.common import LOG, inspection_log, mixed, properties, query, r6, scratch
from plumbline.queries.modelling import INTRINSIC, SMALL, prepared
from plumbline.queries.sources import log_json
from plumbline.queries.splitting import HELD, ROWS
from plumbline.session import stage
from plumbline.streaming import inspections as I

TEST = f"{ROWS}, {HELD}, test AS (SELECT lab.* FROM lab JOIN held USING (ward) WHERE part = 'test')"


def shared_split(spark, sf, **kw):
    """The geographic split by the hash that SQL can compute too."""
    return prepared(spark, sf, key=mixed(F.col("ward")), **kw)


@query("j10_scored_rows", f"{TEST} SELECT property_id, TRUE AS is_probability FROM test")
def j10_rows(spark, sf):
    data = shared_split(spark, sf)
    scored = T.train_boosted(data, SMALL).score(data.matrix("test"))
    sound = F.col("p_lead").between(0, 1) & F.col("p_raw").between(0, 1)
    return scored.select("property_id", sound.alias("is_probability"))


@query("a12_stored_equals_fitted", f"{TEST} SELECT property_id, CAST(0 AS DOUBLE) AS gap, 'v2' AS model_version FROM test")
def a12_equal(spark, sf):
    data, path = shared_split(spark, sf), scratch(spark)
    model = ml.fit_boosted(data.matrix("train"), INTRINSIC, SMALL)
    store.save_model(model, spark, path, "v2", INTRINSIC, data.metadata.first().asDict())
    held = data.matrix("test")
    both = ml.score(model, held, "_a").select("property_id", "_a").join(ml.score(store.load_model(spark, path), held, "_b").select("property_id", "_b"), "property_id")
    version = store.active_version(spark, path).select("model_version").scalar()
    return both.select("property_id", r6(F.abs(F.col("_a") - F.col("_b")), "gap"), version.alias("model_version"))


@query("j16_attributions_add_up", f"{TEST} SELECT property_id, CAST(0 AS DOUBLE) AS gap FROM test")
def j16_sum(spark, sf):
    """The probability is the logistic of twice the margin, and the margin the base value plus the contributions."""
    data = shared_split(spark, sf)
    model = ml.fit_boosted(data.matrix("train"), INTRINSIC, SMALL)
    held = data.matrix("test")
    parts = tree_attributions(model, held, INTRINSIC, "property_id")
    margin = F.aggregate("attributions", F.lit(0.0), lambda a, e: a + e["contribution"]) + F.col("base_value")
    joined = parts.select("property_id", margin.alias("_m")).join(ml.score(model, held, "_p").select("property_id", "_p"), "property_id")
    return joined.select("property_id", r6(F.abs(1.0 / (1.0 + F.exp(-2 * F.col("_m"))) - F.col("_p")), "gap"))


@query("j7_audited_rows", f"{TEST} SELECT count(*) AS n_rows, TRUE AS consistent FROM test")
def j7_rows(spark, sf):
    data = shared_split(spark, sf)
    model = ml.fit_boosted(data.matrix("train"), INTRINSIC, SMALL)
    out = ml.monotone_audit(model, data.matrix("test"), "year_built", [1880, 1920, 1950, 1980], "property_id")
    sound = (F.col("n_violating") <= F.col("n_rows")) & ((F.col("n_violating") > 0) == (F.col("worst_rise") > 1e-12))
    return out.select("n_rows", sound.alias("consistent"))


@query("j15_conformal_job", f"{TEST} SELECT count(*) AS n, TRUE AS consistent FROM test")
def j15_job(spark, sf):
    """Train, store, and report from the store: the groups' rows add up to the global ones, shares are shares."""
    data, path = shared_split(spark, sf), scratch(spark)
    trained = T.train_boosted(data, SMALL)
    store.save_model(trained.model, spark, path, "v2", INTRINSIC, data.metadata.first().asDict(), trained.calibration)
    value = (F.crc32("census_tract") % 1000).cast("double").alias("median_household_income")
    reference = quartiles(properties(spark, sf).select("census_tract").distinct().select("census_tract", value), "median_household_income")
    report = T.conformal_job(spark, path, data, reference)
    grouped = F.sum(F.when(F.col("income_quartile").isNotNull(), F.col("n")).otherwise(0))
    overall = F.sum(F.when(F.col("income_quartile").isNull(), F.col("n")).otherwise(0))
    sound = F.bool_and(F.col("coverage").between(0, 1) & F.col("mean_set_size").between(0, 2))
    return report.agg(overall.alias("n"), ((grouped == overall) & sound).alias("consistent"))


@query("j9_calibration_keeps_order", f"{ROWS} SELECT property_id, rank() OVER (ORDER BY p_lead) AS position FROM lab")
def j9_order(spark, sf):
    """Calibrated probabilities rise with the scores where labels do: one that turned the order round would show."""
    rows = shared_split(spark, sf).rows.withColumn("y", (F.col("p_lead") + F.col("property_id") % 7 / 10 > 0.8).cast("int"))
    p = apply_sigmoid(F.col("p_lead"), *fit_sigmoid(rows, "p_lead", "y"))
    groups = rows.select("property_id", p.alias("_p"))
    from plumbline.operators.ordered import running_totals

    sizes = running_totals(groups.groupBy("_p").agg(F.count("*").alias("n")), "_p", ["n"])
    return groups.join(sizes, "_p").select("property_id", (F.col("n_before") + 1).alias("position"))


@query(
    "l4_pending_total",
    f"WITH {LOG} SELECT count(*) AS pending FROM log WHERE inspected_material IN ('Lead','Copper','Galvanized') AND cost_usd >= 0 AND NOT used_in_training",
)
def l4_total(spark, sf):
    """The last total that the trigger reports is that of the whole log."""
    fired: list[int] = []
    stream = I.read_log(spark, log_json(spark, sf), 1)
    I.retrain_trigger(stream, scratch(spark), 1, lambda batch, pending: fired.append(pending)).awaitTermination()
    return inspection_log(spark, sf).limit(1).select(F.lit(fired[-1]).cast("long").alias("pending"))


@query("j7_staged_precision", f"{TEST} SELECT CAST({SMALL.n_estimators} AS BIGINT) AS n_prefixes, TRUE AS chosen_is_best, TRUE AS margins_agree, count(*) AS n_rows FROM test")
def j7_staged(spark, sf):
    """Stopping keeps the prefix of largest average precision, and staged margins are those of the shorter models."""
    data = shared_split(spark, sf)
    watch, held = data.matrix("calibration"), data.matrix("test")
    model = ml.fit_boosted(data.matrix("train"), INTRINSIC, SMALL)
    curve = stage(staged.staged_precision(model, watch, ml.LABEL))
    chosen = staged.stop_by_precision(model, watch, ml.LABEL, SMALL.patience)
    kept = chosen.stages[-1].getNumTrees
    best = curve.agg(F.max("pr_auc")).scalar() == curve.where(F.col("n_trees") == kept).agg(F.max("pr_auc")).scalar()
    margins = staged.staged_margins(model, held).select("property_id", F.element_at("margins", kept).alias("_m"))
    both = margins.join(ml.score(chosen, held, "_p").select("property_id", "_p"), "property_id")
    near = F.abs(1.0 / (1.0 + F.exp(-2 * F.col("_m"))) - F.col("_p")) < 1e-9
    return both.agg(
        curve.agg(F.count("*")).scalar().alias("n_prefixes"), best.alias("chosen_is_best"), F.every(near).alias("margins_agree"), F.count("*").alias("n_rows")
    )


@query("o6_weighted_fit", f"{TEST} SELECT property_id, CAST(0 AS DOUBLE) AS gap FROM test")
def o6_fit(spark, sf):
    """Trees fitted on weighted rows score as those fitted on rows repeated by their weight."""
    data = shared_split(spark, sf)
    train = data.matrix("train").withColumn(ml.EXAMPLE, (1 + F.col("property_id") % 3).cast("double"))
    repeated = train.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col(ml.EXAMPLE).cast("int")))).drop("_k", ml.EXAMPLE)
    whole = dataclasses.replace(SMALL, subsample=1.0)
    a, b = (ml.score(ml.fit_boosted(rows, INTRINSIC, whole), data.matrix("test"), f"_{n}").select("property_id", f"_{n}") for n, rows in (("a", train), ("b", repeated)))
    return a.join(b, "property_id").select("property_id", r6(F.abs(F.col("_a") - F.col("_b")), "gap"))
