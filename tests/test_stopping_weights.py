"""Stopping on average precision, trials side by side, example weights, bootstrap."""

from __future__ import annotations

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.config import TrainConfig
from plumbline.functions.scores import example_weight
from plumbline.models import pipelines as ml, staged
from plumbline.models.calibration import fit_sigmoid
from plumbline.operators import metrics as M

CFG = TrainConfig(n_estimators=7, max_depth=3, learning_rate=0.4, n_trials=4, subsample=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        data.append((i, a, b, float(rng.random() < 0.1 + 0.7 * (a > 0.6) * b), i % 3 == 0, float(i % 3)))
    return spark.createDataFrame(data, "id long, a double, b double, y double, is_validation boolean, w double").cache()


def test_every_prefix_scores_like_its_own_model(rows):
    model = ml.fit_boosted(rows.where("NOT is_validation"), ["a", "b"], CFG)
    watch = rows.where("is_validation")
    curve = {r.n_trees: r.pr_auc for r in staged.staged_precision(model, watch, "y").collect()}
    assert sorted(curve) == list(range(1, 8))
    for n, value in curve.items():
        shorter = staged.truncated(model, n)
        assert shorter.stages[-1].getNumTrees == n
        assert ml.average_precision(shorter, watch) == pytest.approx(value, abs=1e-12)


def test_stopping_point():
    nan = float("nan")
    assert staged.stopping_point([(1, 0.2), (2, 0.5), (3, 0.5), (4, 0.4)], 30) == 2
    assert staged.stopping_point([(3, 0.3), (1, 0.4), (2, 0.3), (4, 0.3), (5, 0.9)], 3) == 1
    assert staged.stopping_point([(3, 0.3), (1, 0.4), (2, 0.3), (4, 0.3), (5, 0.9)], 4) == 5
    assert staged.stopping_point([(1, nan), (2, nan)], 3) == 2 and staged.stopping_point([(1, nan), (2, 0.1)], 3) == 2
    assert staged.stopping_point([], 3) == 0


def test_a_stopped_model_can_be_stored(spark, rows, tmp_path):
    from pyspark.ml import PipelineModel

    model = ml.fit_boosted(rows, ["a", "b"], CFG, early_stopping=True)
    assert 1 <= model.stages[-1].getNumTrees <= 7
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    both = ml.score(model, rows, "p").select("id", "p").join(ml.score(again, rows, "q").select("id", "q"), "id")
    assert both.where("p <> q").count() == 0 and len(model.stages[-1].featureImportances) == 2


def test_trials_side_by_side_give_the_same_best(rows):
    train, held = rows.where("NOT is_validation"), rows.where("is_validation")
    one, four = (ml.search_boosted(train, held, ["a", "b"], dataclasses.replace(CFG, parallel_trials=k)) for k in (1, 4))
    assert one[0] == four[0] and [tuple(r) for r in one[1].orderBy("trial").collect()] == [tuple(r) for r in four[1].orderBy("trial").collect()]
    assert one[1].count() == 4 and one[0]["pr_auc"] == one[1].agg(F.max("pr_auc")).first()[0]
    late = ml.search_boosted(train, held, ["a", "b"], dataclasses.replace(CFG, search_seconds=-1.0))
    assert late[1].count() == 1


def test_weights_count_like_repeated_rows(rows):
    repeated = rows.withColumn("k", F.explode(F.expr("CASE WHEN w > 0 THEN sequence(1, int(w)) END")))
    a = M.compute_metrics(rows, "y", "b", "id", weight="w").first()
    b = M.compute_metrics(repeated, "y", "b", "id").first()
    for name in ("n", "n_pos", "pr_auc", "roc_auc", "f2", "brier_score"):
        assert a[name] == pytest.approx(b[name], abs=1e-9)
    assert 0 < a["recall_at_20pct"] < 1
    assert fit_sigmoid(rows, "b", "y", "w") == pytest.approx(fit_sigmoid(repeated, "b", "y"), abs=1e-6)
    none = M.compute_metrics(rows.withColumn("w", F.lit(0.0)), "y", "b", "id", weight="w").first()
    assert none["pr_auc"] is None or math.isnan(none["pr_auc"])


def test_trees_of_weighted_rows_beyond_the_sample_for_split_candidates(spark):
    """12,000 repeated rows: Spark samples 10,000 of them for the candidates, but not of the 6,000 weighted ones."""
    unit = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))
    rows = spark.range(6000).select("id", unit(1).alias("a"), unit(2).alias("b"), unit(3).alias("u"))
    rows = rows.select("id", "a", "b", (F.col("u") < 0.2 + 0.6 * F.col("a") * F.col("b")).cast("double").alias("y"))
    weighted = rows.withColumn(ml.EXAMPLE, 1.0 + F.col("id") % 3)
    repeated = weighted.withColumn("k", F.explode(F.expr(f"sequence(1, int({ml.EXAMPLE}))"))).drop("k", ml.EXAMPLE)
    a, b = (ml.score(ml.fit_boosted(df.repartition(n), ["a", "b"], CFG), rows, "p").select("id", "p") for n, df in ((3, weighted), (5, repeated)))
    assert a.join(b.withColumnRenamed("p", "q"), "id").where(F.abs(F.col("p") - F.col("q")) > 1e-9).count() == 0


def test_example_weight(spark):
    df = spark.createDataFrame([("inspected",), ("self_reported",), (None,), ("x",)], "s string")
    got = [r[0] for r in df.select(example_weight(F.col("s"), {"inspected": 2, "self_reported": 0.5})).collect()]
    assert got == [2.0, 0.5, 1.0, 1.0]
    with pytest.raises(ValueError):
        example_weight(F.col("s"), {"x": -1})


def test_bootstrap_interval(rows):
    a, b = (M.bootstrap_precision(rows.repartition(n), "y", "b", "id", 100).first() for n in (2, 5))
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-12)
    assert a.low < a.pr_auc < a.high and a.n_replicates == 100
    narrow = M.bootstrap_precision(rows, "y", "b", "id", 100, level=0.5).first()
    assert a.low < narrow.low < narrow.high < a.high
    draws = rows.sparkSession.range(20_000).select((F.shiftrightunsigned(F.xxhash64(F.lit(42), "id", F.lit(1)), 11) / F.lit(float(1 << 53))).alias("u"))
    mean = draws.select(sum((F.when(F.col("u") >= c, 1.0).otherwise(0.0) for c in M.POISSON), start=F.lit(0.0)).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(mean[0] - 1) < 0.03 and abs(mean[1] - 1) < 0.06
    one_class = M.bootstrap_precision(rows.where("y = 1"), "y", "b", "id", 5).first()
    assert one_class.n_replicates == 0 and one_class.low is None


def test_a_draw_is_hashed_once(rows):
    counted = M.replicate_counts(rows, "y", "b", "id", 20)
    summed = counted.groupBy("replicate", "_p").agg(F.sum(F.col("_y") * F.col("_times")), F.sum("_times"))
    assert summed._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1
    assert counted.rdd.getNumPartitions() >= 8 and counted.count() == 20 * rows.count()
