"""Training, scoring, calibration, explanation and back-testing on the derived assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.config import ScoringConfig, TrainConfig
from plumbline.models import pipelines as ml, store
from plumbline.models.attributions import tree_attributions
from plumbline.models.calibration import apply_sigmoid, fit_sigmoid
from plumbline.operators import impute
from plumbline.operators.explain import importance_table
from plumbline.plans import train as T
from plumbline.plans.backtest import back_test
from plumbline.plans.features import add_cells, base_features
from plumbline.queries.common import LAT0, LON0, points, properties, query, scratch
from plumbline.session import stage

SMALL = TrainConfig(n_estimators=8, max_depth=3, learning_rate=0.3, forest_trees=10, forest_depth=5, logistic_iterations=50, n_trials=2)
INTRINSIC = fv.INTRINSIC


def filled(spark, sf, dated=False):
    rows = add_cells(properties(spark, sf, dated), LAT0, LON0)
    return stage(impute.apply(rows, impute.fit(rows)))


def unfilled(spark, sf, dated=False):
    """Gaps stay: the jobs fill them with values of their training rows."""
    return stage(base_features(properties(spark, sf, dated), points(spark, sf), LAT0, LON0, fitted=spark.range(1).select()))


def prepared(spark, sf, features=INTRINSIC, mode="geographic", **kw):
    dated = mode != "geographic" or any(f in fv.PROCESS for f in features)
    return T.prepare(unfilled(spark, sf, dated), mode, features, min_test_rows=None, **kw)


@query("j4_baseline_models")
def j4(spark, sf):
    """Heuristic, standardised logistic regression and random forest on one geographic split."""
    return T.baseline_metrics(prepared(spark, sf, fv.LINEAR_FEATURES), TrainConfig())


@query("j7_boosted_calibrated")
def j7(spark, sf):
    """Boosted trees with early stopping, sigmoid calibration on CAL, metrics on TEST."""
    data = prepared(spark, sf)
    return T.evaluate(T.train_boosted(data, SMALL), data, baseline_ap=0.3)


@query("j7_full_size")
def j7_full(spark, sf):
    """As above with all trees of the default depth, over the features that lie in place and neighbourhood too."""
    data = prepared(spark, sf, fv.FEATURE_SETS["intrinsic_geo"])
    return T.evaluate(T.train_boosted(data, TrainConfig()), data, baseline_ap=0.3)


@query("j7_monotone_audit")
def j7_audit(spark, sf):
    data = prepared(spark, sf)
    model = ml.fit_boosted(data.matrix("train"), INTRINSIC, SMALL)
    return ml.monotone_audit(model, data.matrix("test"), "year_built", [1880, 1900, 1920, 1950, 1980, 2005], "property_id")


@query("j8_hyper_parameter_search")
def j8(spark, sf):
    data = prepared(spark, sf)
    train, held = data.matrix("train"), data.matrix("calibration")
    return ml.search_boosted(train, held, INTRINSIC, SMALL)[1]


@query("j9_sigmoid_calibration")
def j9(spark, sf):
    rows = prepared(spark, sf).rows.withColumn("y", (F.col("service_line_material") == "Lead").cast("int"))
    slope, intercept = fit_sigmoid(rows, "p_lead", "y")
    return rows.select("property_id", apply_sigmoid(F.col("p_lead"), slope, intercept).alias("p_calibrated"))


@query("j10_batch_scores")
def j10(spark, sf):
    data = prepared(spark, sf)
    trained = T.train_boosted(data, SMALL)
    return trained.score(data.matrix("test")).select("property_id", "p_raw", "p_lead")


@query("j11_propensity_model")
def j11(spark, sf):
    """Fitted at full size and kept in the model store; its metrics with the stored version."""
    path, cfg = scratch(spark), TrainConfig(max_depth=5)
    out = T.propensity(unfilled(spark, sf), fv.PROPENSITY_FEATURES, "property_id", "service_line_material", cfg, path=path)
    version = store.active_version(spark, path).select("model_version").scalar()
    return out.withColumn("model_version", version)


@query("j16_tree_attributions")
def j16_tree(spark, sf):
    data = prepared(spark, sf)
    model = ml.fit_boosted(data.matrix("train"), INTRINSIC, SMALL)
    out = tree_attributions(model, data.matrix("test"), INTRINSIC, "property_id")
    return out.select("property_id", F.inline("attributions"))


@query("j18_model_importance")
def j18_model(spark, sf):
    model = ml.fit_boosted(prepared(spark, sf).matrix("train"), INTRINSIC, SMALL)
    return importance_table(spark, INTRINSIC, model.stages[-1].featureImportances.toArray())


@query("j20_explanation_job")
def j20(spark, sf):
    data = prepared(spark, sf)
    return T.explanation_tables(T.train_boosted(data, SMALL), data)[1]


@query("a12_model_store")
def a12(spark, sf):
    """Save with metadata, load with the class check, score, and read the active version."""
    data, path = prepared(spark, sf), scratch(spark)
    trained = T.train_boosted(data, SMALL)
    store.save_model(trained.model, spark, path, "v2", INTRINSIC, data.metadata.first().asDict(), trained.calibration)
    scored = ml.score(store.load_model(spark, path), data.matrix("test"))
    version = store.active_version(spark, path).select("model_version").scalar()
    return scored.select("property_id", "p_lead", version.alias("model_version"))


@query("k6_acquisition_back_test")
def k6(spark, sf):
    """All policies, two rounds; the ward history is rebuilt from the visible labels every round."""
    cfg = ScoringConfig(n_rounds=2, batch_size=50)
    small = TrainConfig(n_estimators=3, max_depth=3, learning_rate=0.3)
    return back_test(filled(spark, sf, True), features=INTRINSIC + fv.PROCESS, cfg=cfg, train=small)


@query("i8_ablation_grid")
def i8(spark, sf):
    folds = [
        {"name": "geographic", "mode": "geographic"},
        {"name": "temporal-1", "mode": "temporal", "cutoff": "2000-01-01", "test_start": "2000-04-01", "test_end": "2001-01-01"},
        {"name": "temporal-2", "mode": "temporal", "cutoff": "2001-01-01", "test_start": "2001-04-01", "test_end": "2002-01-01"},
    ]
    small = TrainConfig(n_estimators=3, max_depth=3, learning_rate=0.3)
    return T.ablation(unfilled(spark, sf, True), folds, tuple(fv.FEATURE_SETS), small, min_test_rows=None)
