from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import conformal as C, equity, metrics as M, splits as P
from plumbline.operators.queue import affordable, budget_queue, budget_queue_variable


@pytest.fixture(scope="module")
def assets(spark):
    n = 600
    rows = [(i, i % 12, "Lead" if i % 4 == 0 else "Copper", f"20{10 + i % 10}-03-01") for i in range(n)]
    df = spark.createDataFrame(rows, "property_id int, ward int, service_line_material string, d string")
    return df.withColumn("inspected_at", F.col("d").cast("timestamp_ntz")).drop("d").cache()


@pytest.mark.parametrize("mode", P.MODES)
def test_split_dataset(assets, mode):
    rows, meta = P.split_dataset(assets, mode, "property_id", "service_line_material", cutoff="2015-01-01")
    m = meta.first()
    parts = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    assert m["status"] == "OK" and parts["train"] == m["train_rows"] and parts["test"] > 0
    again, _ = P.split_dataset(assets.repartition(17), mode, "property_id", "service_line_material", cutoff="2015-01-01")
    a, b = (sorted(tuple(r) for r in x.select("property_id", "split").collect()) for x in (rows, again))
    assert a == b


def test_random_split_is_stratified(assets):
    rows, _ = P.split_dataset(assets, "random", "property_id", "service_line_material")
    shares = rows.groupBy("split").agg(F.avg((F.col("service_line_material") == "Lead").cast("int")).alias("s")).collect()
    assert all(abs(r["s"] - 0.25) < 0.02 for r in shares)


def test_split_errors(assets, spark):
    for bad in ({"mode": "other"}, {"mode": "temporal"}, {"mode": "temporal", "cutoff": "2050-01-01"}):
        with pytest.raises(ValueError):
            P.split_dataset(assets, row_id="property_id", label="service_line_material", **bad)
    with pytest.raises(ValueError):
        P.split_dataset(assets.where("ward > 99"), "geographic", "property_id", "service_line_material")
    one = assets.where("ward = 3")
    _, meta = P.split_dataset(one, "geographic", "property_id", "service_line_material", min_test_rows=5)
    assert meta.first()["status"] == "INSUFFICIENT_SAMPLE" and meta.first()["test_rows"] == 0


def test_null_group_trains(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, ward int")
    got = {r["id"]: r["split"] for r in P.by_groups(df, "ward", P.listed_groups(df, "ward", [5])).collect()}
    assert got == {1: "train", 2: "calibration"}


def average_precision(y, p):
    order = np.argsort(-p, kind="stable")
    y, p = y[order], p[order]
    edge = np.r_[np.where(np.diff(p))[0], len(y) - 1]
    tp, seen = np.cumsum(y)[edge], edge + 1
    recall = tp / y.sum()
    return float(np.sum(np.diff(np.r_[0, recall]) * tp / seen))


def test_metrics_with_ties(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 800), rng.integers(0, 20, 800) / 20
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(800), "y": y, "p": p}))
    m = M.compute_metrics(df, "y", "p", "id", prefix="t_").first()
    assert m["t_pr_auc"] == pytest.approx(average_precision(y, p))
    pos, neg = p[y == 1][:, None], p[y == 0][None]
    assert m["t_roc_auc"] == pytest.approx(((pos > neg) + 0.5 * (pos == neg)).mean())
    assert m["t_brier_score"] == pytest.approx(((p - y) ** 2).mean())
    top = np.lexsort((np.arange(800), -p))[:160]
    assert m["t_recall_at_20pct"] == pytest.approx(y[top].sum() / y.sum())


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.9)], "id int, y int, p double")
    m = M.compute_metrics(df, "y", "p", "id").first()
    assert math.isnan(m["pr_auc"]) and math.isnan(m["roc_auc"]) and math.isnan(m["recall_at_20pct"]) and m["f2"] == 0.0


def test_leakage_gap(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.6, 0.5), (0.5, 0.0)], "r double, g double")
    assert [r["gap_ok"] for r in M.leakage_gap(df, "r", "g").collect()] == [True, False, False]


def test_conformal_coverage(spark):
    rng = np.random.default_rng(1)
    scores = spark.createDataFrame(pd.DataFrame({"score": rng.random(1000), "income_quartile": rng.integers(1, 5, 1000)}))
    t = C.thresholds(scores.limit(1000), "score").first()["threshold"]
    assert 0.85 < t < 0.95
    groups = C.group_thresholds(scores, "score", "income_quartile").collect()
    assert len(groups) == 4 and all(0.8 < r["threshold"] < 1 for r in groups)
    few = spark.createDataFrame([(0.1, 1), (0.2, 1), (0.9, 2)], "score double, income_quartile int")
    t1 = {r["income_quartile"]: r["threshold"] for r in C.group_thresholds(few, "score", "income_quartile").collect()}
    assert t1[1] == t1[2] == t1[4] == pytest.approx(0.9)


def test_prediction_sets(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "p double")
    sets = lambda t: [tuple(r[0]) for r in df.select(C.prediction_set(F.col("p"), F.lit(t).cast("double"))).collect()]
    assert sets(0.5) == [("NotLead",), ("NotLead", "Lead"), ("Lead",)]
    assert sets(0.05) == [("NotLead",), ("NotLead",), ("Lead",)]
    with pytest.raises(Exception, match="calibrated"):
        sets(None)
    with pytest.raises(ValueError):
        C.check_alpha(1.0)


def test_quartiles(spark):
    df = spark.createDataFrame([(30e3,), (50e3,), (70e3,), (100e3,)], "income double")
    assert {r["income_quartile"] for r in equity.quartiles(df, "income").collect()} == {1, 2, 3, 4}
    with pytest.raises(Exception, match="unique"):
        equity.quartiles(spark.createDataFrame([(1.0,)] * 6, "income double"), "income").collect()


def test_equity_properties(spark):
    preds = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 0.5), ("b", 0.5), (None, 0.0)], "census_tract string, p_lead double")
    seen = spark.createDataFrame([("a",)] * 9 + [("b",)], "census_tract string")
    got = {r["census_tract"]: r["equity_boost"] for r in equity.equity_boost(preds, seen).collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(0.8)
    per_area = seen.groupBy("census_tract").count()
    assert got == {r["census_tract"]: r["equity_boost"] for r in equity.equity_boost(preds, per_area, count="count").collect()}
    assert {r["equity_boost"] for r in equity.equity_boost(preds, seen.limit(0)).collect()} == {1.0}
    assert {r["equity_boost"] for r in equity.equity_boost(preds.withColumn("p_lead", F.lit(0.0)), seen).collect()} == {0.0}


def test_queue(spark):
    df = spark.createDataFrame([(i, i / 10, 100.0 * i) for i in range(1, 8)], "id int, s double, c double")
    ids = lambda q: [r["id"] for r in q.orderBy("rank").collect()]
    assert ids(budget_queue(df, "s", "id", 1499.0)) == [7, 6]
    assert ids(budget_queue(df, "s", "id", 100.0)) == []
    assert len(ids(budget_queue(df, "s", "id", 0.0, 3, 0.0))) == 3
    assert ids(budget_queue_variable(df, "s", "id", "c", 1350.0)) == [7, 6]
    for bad in ((-1, 1, 1), (1, -1, 1), (1, 1, 0), (1, 1, 10_001)):
        with pytest.raises(ValueError):
            affordable(*bad)
