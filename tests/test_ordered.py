from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators.history import as_of_history
from plumbline.operators.ordered import first_by, global_rank, hash_rank, quantile, running_totals


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 4000
    hot = rng.random(n) < 0.4  # one value holds over a third of the rows
    pdf = pd.DataFrame({"id": np.arange(n), "v": np.where(hot, 0.25, rng.random(n).round(3)), "g": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 5, n))})
    return pdf, spark.createDataFrame(pdf).repartition(13).cache()


@pytest.mark.parametrize("partitions", [None, 1, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(rows, partitions, descending):
    pdf, df = rows
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = running_totals(counts, "v", ["n"], ["g"], descending, partitions).toPandas().sort_values(["g", "v"], ascending=[True, not descending])
    want = pdf.groupby(["g", "v"]).size().reset_index(name="n").sort_values(["g", "v"], ascending=[True, not descending])
    before = want.groupby("g")["n"].cumsum() - want["n"]
    assert got["n_before"].tolist() == before.tolist() and got["n"].tolist() == want["n"].tolist()


@pytest.mark.parametrize("partitions", [None, 1, 30])
@pytest.mark.parametrize("level", [0.0, 0.37, 0.9, 1.0])
def test_quantile(rows, partitions, level):
    pdf, df = rows
    got = quantile(df, "v", F.lit(level), partitions=partitions).first()
    assert got["n_rows"] == len(pdf) and got["quantile"] == pytest.approx(np.quantile(pdf.v, level), abs=1e-12)
    by = {r["g"]: r["quantile"] for r in quantile(df, "v", F.lit(level), ["g"], partitions=partitions).collect()}
    assert by == pytest.approx(pdf.groupby("g").v.quantile(level).to_dict(), abs=1e-12)


@pytest.mark.parametrize("partitions", [1, 17])
def test_ranks_do_not_depend_on_partitions(rows, partitions):
    pdf, df = rows
    moved = df.repartition(partitions)
    got = global_rank(moved, [F.desc("v"), F.asc("id")]).orderBy("rank").toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert got["rank"].tolist() == list(range(1, len(pdf) + 1)) and got["id"].tolist() == want["id"].tolist()
    hashed = hash_rank(moved, F.shiftrightunsigned(F.xxhash64("id", F.lit(1)), 32), "id", ["g"]).toPandas()
    for _, part in hashed.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    again = hash_rank(df.repartition(5), F.shiftrightunsigned(F.xxhash64("id", F.lit(1)), 32), "id", ["g"]).toPandas()
    assert hashed.set_index("id")["rank"].to_dict() == again.set_index("id")["rank"].to_dict()


@pytest.mark.parametrize("descending", [False, True])
def test_nulls_and_nan_take_their_place_at_every_number_of_ranges(spark, descending):
    values = [None, float("nan"), float("inf"), float("-inf"), *(i / 7 for i in range(60))]
    rows = [(g, v, i) for g in ("a", "b", None) for i, v in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    place = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    want = {}
    for g in ("a", "b", None):
        total = 0
        for v, n in sorted(((v, n) for k, v, n in rows if k == g), key=lambda r: place(r[0]), reverse=descending):
            want[g, n] = total
            total += n
    for partitions in (None, 1, 4, 50):
        got = running_totals(df, "v", ["n"], ["g"], descending, partitions).collect()
        assert {(r.g, r.n): r.n_before for r in got} == want and len(got) == len(rows)


def test_quantile_keeps_a_null_group_and_nan(spark):
    df = spark.createDataFrame([(g, float(v)) for g in ("a", None) for v in range(9)] + [(None, float("nan")), ("a", None)], "g string, v double")
    for partitions in (None, 1, 20):
        got = {r.g: (r.n_rows, r.quantile) for r in quantile(df, "v", F.lit(0.5), ["g"], partitions=partitions).collect()}
        assert got == {"a": (9, 4.0), None: (10, 4.5)}


def test_first_by(rows):
    pdf, df = rows
    got = {r["g"]: r["id"] for r in first_by(df, ["g"], [-F.col("v"), F.col("id")]).collect()}
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("g").id.first().to_dict()
    assert got == want


def test_as_of_history_is_strict_and_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n), "t": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 40, n), unit="D"), "lab": rng.random(n) < 0.7, "hit": rng.random(n) < 0.3})
    got = as_of_history(spark.createDataFrame(pdf), "g", "t", F.col("hit"), F.col("lab")).toPandas().set_index("id")
    for r in pdf.itertuples():
        past = pdf[(pdf.g == r.g) & (pdf.t < r.t) & pdf.lab]
        mine = got.loc[r.id]
        assert (mine.prior_count, mine.prior_positives) == (len(past), past.hit.sum())
        last = past.t.max()
        assert pd.isna(mine.prior_last_us) if pd.isna(last) else mine.prior_last_us == last.value // 1000


def test_as_of_history_keeps_rows_without_time_or_group(spark):
    rows = [(1, "a", "2020-01-01"), (2, "a", "2020-01-02"), (3, None, "2020-01-03"), (4, "a", None), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, g string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.id: (r.prior_count, r.prior_last_us is None) for r in as_of_history(df, "g", "t", F.lit(True), F.lit(True)).collect()}
    assert got == {1: (0, True), 2: (1, False), 3: (0, True), 4: (0, True), 5: (0, True)}


def test_splits_keep_rows_without_stratum_or_time(spark):
    from plumbline.operators.splits import random_split, temporal_split

    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("s"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("t"))
    out = random_split(df, "id", F.col("s")).collect()
    assert len(out) == 100 and sum(r.split == "test" for r in out if r.s is None) == 3
    halves = temporal_split(df, "t", F.lit(50), "id").collect()
    assert len(halves) == 100 and all((r.split is None) == (r.t is None) for r in halves)
