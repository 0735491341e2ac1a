from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import spatial


def distances(a, b):
    la1, lo1 = np.radians(a.latitude.to_numpy())[:, None], np.radians(a.longitude.to_numpy())[:, None]
    la2, lo2 = np.radians(b.latitude.to_numpy())[None], np.radians(b.longitude.to_numpy())[None]
    h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6_371_000 * np.arcsin(np.sqrt(np.minimum(1, h)))


def cloud(rng, n, kind):
    if kind == "world":
        lat, lon = np.degrees(np.arcsin(rng.random(n) * 2 - 1)), rng.random(n) * 360 - 180
    else:
        lat, lon = 41.64 + rng.random(n) * 0.38, -87.94 + rng.random(n) * 0.42
    if kind == "skewed":
        tight, copies = rng.random(n) < 0.5, rng.random(n) < 0.35
        lat[tight], lon[tight] = 41.8 + rng.normal(size=tight.sum()) * 1e-4, -87.7 + rng.normal(size=tight.sum()) * 1e-4
        lat[copies], lon[copies] = 41.9, -87.6
    return pd.DataFrame({"id": np.arange(n), "latitude": lat, "longitude": lon, "y": rng.integers(0, 2, n)})


@pytest.mark.parametrize("kind", ["city", "world", "skewed"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(11)
    q, r = cloud(rng, 400, kind), cloud(rng, 900, kind)
    d = distances(q, r)
    sq, sr = spark.createDataFrame(q), spark.createDataFrame(r)
    near = spatial.nearest_distance(sq, sr, "metres", 5000.0).toPandas().sort_values("id")
    assert np.allclose(near.metres, d.min(axis=1), atol=1e-6)
    found = spatial.knn_join(sq, sr, 7, "id").toPandas().sort_values("id")
    want = [tuple(r.id.to_numpy()[np.lexsort((r.id, np.round(row, 6)))[:7]]) for row in d]
    assert [tuple(e.ref_id for e in row) for row in found.neighbours] == want


def test_exclude_self_and_exact_ties(spark):
    same = spark.createDataFrame([(i, 41.8, -87.6, i % 2) for i in range(30)], "id int, latitude double, longitude double, y int")
    found = spatial.knn_join(same, same, 3, "id", exclude_self="id").orderBy("id").collect()
    assert [e.ref_id for e in found[0].neighbours] == [1, 2, 3]
    assert [e.ref_id for e in found[2].neighbours] == [0, 1, 3]
    assert [e.ref_id for e in found[29].neighbours] == [0, 1, 2]


def test_rate_defaults(spark):
    q = spark.createDataFrame([(1, 41.8, -87.6), (2, None, None)], "id int, latitude double, longitude double")
    few = spark.createDataFrame([(i, 41.8, -87.6 + i / 1000, 1) for i in range(4)], "id int, latitude double, longitude double, y int")
    assert [r.rate for r in spatial.knn_rate(q, few, 10, "id", F.col("y") == 1, "rate").collect()] == [0.0, 0.0]
    assert {r.rate for r in spatial.knn_rate(q, few.where("y = 0"), 10, "id", F.col("y") == 1, "rate").collect()} == {0.0}
    assert {r.m for r in spatial.nearest_distance(q, few.where("y = 0"), "m", 77.0).collect()} == {77.0}
    got = {r.id: r.rate for r in spatial.knn_rate(q, few, 3, "id", F.col("y") == 1, "rate").collect()}
    assert got[1] == 1.0


def test_no_cross_join_in_plan(spark, sf):
    from plumbline.queries.common import points, properties

    df = spatial.nearest_distance(properties(spark, sf), points(spark, sf), "metres", 5000.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def spot(n, seed=4):
    """`n` points within a metre, one on the far side of the world, and one spot within that spot."""
    rng = np.random.default_rng(seed)
    lat, lon = 41.8 + rng.random(n) * 9e-6, -87.7 + rng.random(n) * 9e-6
    inner = rng.random(n) < 0.3
    lat[inner], lon[inner] = 41.8 + rng.random(inner.sum()) * 1e-9, -87.7 + rng.random(inner.sum()) * 1e-9
    lat[0], lon[0] = -33.0, 151.0
    return pd.DataFrame({"id": np.arange(n), "latitude": lat, "longitude": lon})


def test_dense_spot_equals_brute_force(spark):
    r = spot(3000)
    q = pd.concat([r.sample(200, random_state=1), cloud(np.random.default_rng(2), 50, "world")[["id", "latitude", "longitude"]]]).reset_index(drop=True)
    q["id"] = np.arange(len(q))
    near = spatial.nearest_distance(spark.createDataFrame(q), spark.createDataFrame(r), "metres", 5000.0).toPandas().sort_values("id")
    assert np.allclose(near.metres, distances(q, r).min(axis=1), atol=1e-5)


def test_dense_spot_takes_linear_work(spark):
    """Pairs of cells and the rows in the largest leaf, at two sizes."""
    work = {}
    for n in (10_000, 100_000):
        rows = spark.createDataFrame(spot(n))
        r = spatial.stage(spatial._reference(rows, "latitude", "longitude", None, (), 1))
        scale = (1 << spatial.FINEST_BITS) / 4.0
        grid = r.withColumns({f"i{a}": F.floor((F.col(a) + 2.0) * scale) for a in spatial.AXES})
        tree, levels = spatial._reference_tree(grid, spatial.START_LEVEL, spatial.LEAF_ROWS, 4.0)
        cells = spatial.stage(spatial._cells(grid, levels))
        pairs = spatial._leaf_pairs(cells, tree, 1, levels)
        sizes = tree.where("leaf").select(F.col("level").alias("rlevel"), F.col("code").alias("rcode"), "n")
        asked = cells.select(F.col("level").alias("qlevel"), F.col("code").alias("qcode"), F.col("n").alias("m"))
        joined = pairs.join(sizes, ["rlevel", "rcode"]).join(asked, ["qlevel", "qcode"])
        work[n] = joined.agg(F.sum(F.col("n") * F.col("m")), F.max("n")).first()
        assert levels == sorted(levels) and len(levels) < 20
    assert work[100_000][0] < 15 * work[10_000][0] and work[100_000][1] < 300


def test_many_ranges_and_chunks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "TASK_ROWS", 100)
    monkeypatch.setattr(spatial, "CHUNK_LEAVES", 1)
    rng = np.random.default_rng(12)
    q, r = cloud(rng, 300, "skewed"), cloud(rng, 900, "skewed")
    d = distances(q, r)
    found = spatial.knn_join(spark.createDataFrame(q), spark.createDataFrame(r), 7, "id").toPandas().sort_values("id")
    want = [tuple(r.id.to_numpy()[np.lexsort((r.id, np.round(row, 6)))[:7]]) for row in d]
    assert [tuple(e.ref_id for e in row) for row in found.neighbours] == want


def test_tables_that_grow_are_not_broadcast(spark):
    """Estimates of well-compressed inputs are too small, whatever the size."""
    rows = spark.createDataFrame(spot(3000))
    near, lists = spatial.nearest_distance(rows, rows, "metres", 5000.0), spatial.knn_join(rows, rows, 3, "id")
    for df in (near, lists):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
