from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.config import ScoringConfig, TrainConfig
from plumbline.models import pipelines as ml, store
from plumbline.models.attributions import base_value, leaf_rules, tree_attributions
from plumbline.models.calibration import fit_sigmoid
from plumbline.operators import explain, quality as Q
from plumbline.plans import train as T
from plumbline.plans.backtest import back_test
from plumbline.plans.features import LABEL_FEATURES, add_cells, base_features, label_features, write_base_features
from plumbline.queries.common import LAT0, LON0, points, properties
from plumbline.session import stage

TINY = TrainConfig(n_estimators=4, max_depth=3, learning_rate=0.3, forest_trees=4, forest_depth=3, logistic_iterations=20, n_trials=1)


@pytest.fixture(scope="module")
def rows(spark, sf):
    full = properties(spark, sf, dated=True).na.fill({"year_built": 1950, "building_sqft": 1500.0, "stories": 1.0})
    return stage(add_cells(full, LAT0, LON0))


def features(df, reference, **kw):
    out = label_features(df, reference, "property_id", **kw)
    return out.select("property_id", *LABEL_FEATURES).toPandas().sort_values("property_id").reset_index(drop=True)


def test_held_out_labels_cannot_reach_features(rows):
    train, test = rows.where("ward < 12 and service_line_material is not null"), rows.where("ward >= 12")
    plain = features(test, train)
    for forged in (F.lit("Lead"), F.lit(None).cast("string")):
        pd.testing.assert_frame_equal(plain, features(test.withColumn("service_line_material", forged), train))


def test_reference_labels_do_reach_features(rows):
    train, test = rows.where("ward < 12 and service_line_material is not null"), rows.where("ward >= 12")
    other = train.withColumn("service_line_material", F.when(F.col("service_line_material") == "Lead", "Copper").otherwise("Lead"))
    assert not features(test, train).equals(features(test, other))


def test_own_label_is_hidden_with_exclude_self(rows):
    train = rows.where("service_line_material is not null")
    some = [r[0] for r in train.select("property_id").orderBy("property_id").limit(5).collect()]
    mine = F.col("property_id").isin(some[:1])
    flipped = train.withColumn("service_line_material", F.when(mine & (F.col("service_line_material") == "Lead"), "Copper").when(mine, "Lead").otherwise(F.col("service_line_material")))
    pick = lambda ref: features(ref.where(mine), ref, exclude_self=True).drop(columns=["days_since_last_inspection_in_ward"])
    pd.testing.assert_frame_equal(pick(train), pick(flipped))


def test_late_labels(rows):
    train = rows.where("service_line_material is not null")
    as_of = F.lit("1999-01-01").cast("timestamp_ntz")
    with pytest.raises(ValueError, match="after the prediction time"):
        label_features(rows, train, "property_id", as_of=as_of)
    out = label_features(rows, train, "property_id", as_of=as_of, late_labels="drop", wanted=fv.PROCESS)
    assert out.agg(F.max("inspection_count_in_ward")).first()[0] <= train.where(F.col("inspected_at") <= as_of).count()


def test_empty_reference_defaults(rows):
    none = rows.where("ward = 99")
    got = features(rows.where("ward = 1"), none)
    assert set(got.dist_to_nearest_known_lead_m) == {10000.0} and set(got.knn10_lead_rate) == {0.0}
    assert set(got.neighbor_lead_rate_h3res8) == {0.0} and set(got.days_since_last_inspection_in_ward) == {3650.0}


def test_base_features(spark, sf, tmp_path):
    out = base_features(properties(spark, sf), points(spark, sf), LAT0, LON0)
    assert out.where("year_built is null or stories is null").count() == 0
    write_base_features(out, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == out.count()
    with pytest.raises(Q.QualityError, match="race"):
        write_base_features(out.withColumn("race", F.lit(1)), str(tmp_path / "g"))
    assert not set(fv.FORBIDDEN_COLUMNS) & {c for s in fv.FEATURE_SETS.values() for c in s}


def test_feature_contract(rows):
    got = Q.feature_contract(rows, ["stories", "year_built"])
    assert got.columns == ["stories", "year_built"] and {t for _, t in got.dtypes} == {"double"}
    with pytest.raises(Q.FeatureContractError, match="nope"):
        Q.feature_contract(rows, ["nope", "year_built"])


def test_validation_gathers_everything(spark):
    bad = spark.createDataFrame([("a", 5), ("a", 1), (None, 2)], "census_tract string, income_quartile int")
    with pytest.raises(Q.QualityError) as e:
        Q.validate(bad, Q.FAIRNESS_REFERENCE)
    assert all(word in str(e.value) for word in ("allowed_values", "unique", "not_null"))
    good = spark.createDataFrame([("a", "3")], "census_tract string, income_quartile string")
    assert Q.validate(good, Q.FAIRNESS_REFERENCE).dtypes[1][1] == "int"


@pytest.fixture(scope="module")
def data(rows):
    return T.prepare(rows, "geographic", fv.INTRINSIC, min_test_rows=None)


def test_train_store_and_explain(spark, data, tmp_path):
    trained = T.train_boosted(data, TINY)
    held = data.matrix("test")
    scored = trained.score(held)
    assert scored.where("p_lead < 0 or p_lead > 1").count() == 0
    path = str(tmp_path / "model")
    with pytest.raises(ValueError, match="split_mode"):
        store.save_model(trained.model, spark, path, "v2", trained.features, {})
    store.save_model(trained.model, spark, path, "v2", trained.features, data.metadata.first().asDict(), trained.calibration)
    again = ml.score(store.load_model(spark, path), held, "p").agg(F.sum("p")).first()[0]
    assert again == pytest.approx(scored.agg(F.sum("p_raw")).first()[0])
    assert store.active_version(spark, path).first()["model_version"] == "v2"

    # attributions and the base add up to the margin; the probability is the logistic of twice the margin
    parts = tree_attributions(trained.model, held, trained.features, "property_id")
    total = F.aggregate("attributions", F.lit(0.0), lambda a, e: a + e["contribution"]) + F.col("base_value")
    joined = parts.withColumn("margin", total).join(scored, "property_id")
    gap = joined.select(F.max(F.abs(F.lit(1.0) / (1 + F.exp(-2 * F.col("margin"))) - F.col("p_raw")))).first()[0]
    assert gap < 1e-9
    assert base_value(leaf_rules(trained.model)) == pytest.approx(parts.first()["base_value"])


def test_propensity_model_is_stored(spark, rows, tmp_path):
    path, cfg = str(tmp_path / "p"), TrainConfig(n_estimators=2, max_depth=2)
    out = T.propensity(rows, fv.INTRINSIC, "property_id", "service_line_material", cfg, path=path).first()
    assert 0 < out["baseline"] <= 1
    active = store.active_version(spark, path).first()
    assert active["model_version"] == "propensity" and tuple(active["feature_names"]) == tuple(fv.INTRINSIC)
    assert '"target": "inspected"' in active["split_metadata"]
    filled = rows.select("property_id", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in fv.INTRINSIC])
    scored = ml.score(store.load_model(spark, path), filled, "p_seen")
    assert scored.where("p_seen < 0 OR p_seen > 1 OR p_seen IS NULL").count() == 0


def test_sigmoid_matches_newton(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * s - 0.3)))).astype(int)
    slope, intercept = fit_sigmoid(spark.createDataFrame(pd.DataFrame({"s": s, "y": y})), "s", "y")
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, b = np.c_[s, np.ones_like(s)], np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (t - q))
    assert (slope, intercept) == pytest.approx(tuple(b), abs=1e-5)


def test_monotone_repair(data):
    model = ml.fit_boosted(data.matrix("train"), fv.INTRINSIC, TINY)
    grid = [1880, 1900, 1950, 2000]
    held = data.matrix("test")
    fixed = ml.monotone_scores(model, held, "year_built", grid, "property_id")
    raw = ml.score(model, held, "p_raw").select("property_id", "p_raw")
    assert fixed.join(raw, "property_id").where("p_lead > p_raw + 1e-12").count() == 0
    audit = ml.monotone_audit(model, held, "year_built", grid, "property_id").first()
    assert audit["n_rows"] == held.count() and 0 <= audit["n_violating"] <= audit["n_rows"]


def test_baselines(data):
    got = {r["model"]: r for r in T.baseline_metrics(data, TINY).collect()}
    assert set(got) == {"heuristic", "logistic_regression", "random_forest"}
    assert all(0 <= r["pr_auc"] <= 1 for r in got.values())


def test_back_test_grows_and_counts(rows):
    cfg = ScoringConfig(n_rounds=2, batch_size=10)
    features_ = fv.INTRINSIC + ("known_lead_rate_in_ward",)
    curve = back_test(rows, strategies=("uncertainty", "oracle"), features=features_, cfg=cfg, train=TINY).toPandas()
    for _, part in curve.groupby("strategy"):
        assert part.cumulative_inspections.diff().dropna().eq(10).all() and part.cumulative_discoveries.is_monotonic_increasing
        assert (part.cumulative_cost_usd == (part.cumulative_inspections - part.cumulative_inspections.iloc[0]) * 500).all()
    oracle = curve[curve.strategy == "oracle"]
    assert oracle.cumulative_discoveries.iloc[1] == 10


def test_top_contributions(spark):
    df = spark.createDataFrame([([("a", 0.1), ("b", -0.9), ("c", 0.5)],)], "x array<struct<feature:string,contribution:double>>")
    best = df.select(explain.top_contributions(F.col("x"), 2)).first()[0]
    assert [(e.feature, e.contribution) for e in best] == [("b", -0.9), ("c", 0.5)]
    assert len(df.select(explain.top_contributions(F.col("x"), 9)).first()[0]) == 3


def test_prepared_rows_are_dealt_evenly_over_the_cores(spark):
    row = F.col("id")
    labels = F.element_at(F.array(*[F.lit(x) for x in ("Lead", "Copper", "Galvanized")]), (row % 3 + 1).cast("int"))
    base = spark.range(0, 20_000, 1, 1).select(row.alias("property_id"), (row % 40).alias("ward"), (1900 + row % 100).alias("year_built"), labels.alias("service_line_material"))
    rows = T.prepare(base, "geographic", ["year_built"], min_test_rows=None).rows
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 8 and sum(sizes) == 20_000 and max(sizes) <= 1.1 * min(sizes)
