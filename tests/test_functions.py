from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.config import ScoringConfig
from plumbline.functions import scores as S, text as X
from plumbline.functions.geo import haversine_m, hex_cell


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text(spark):
    row = one(
        spark,
        X.normalise_text(F.lit(" 123 MAIN  St ")).alias("a"), X.stable_id(F.lit("123 main st"), F.lit("12345")).alias("i"),
        X.stable_id(F.lit("x"), F.lit(None).cast("string")).alias("n"), X.zero_pad(F.lit("1234567"), 6).alias("z"), X.zero_pad(F.lit("12"), 6).alias("y"),
        X.canonical(F.lit(" GALVANIZED steel ")).alias("c"), X.canonical(F.lit("wood")).alias("w"), X.to_number(F.lit("abc")).alias("t"),
    )
    assert row["a"] == "123 main st"
    assert row["i"] == "chi-" + hashlib.sha256(b"123 main st|12345").hexdigest()[:12] and len(row["i"]) == 16
    assert row["n"] == "chi-" + hashlib.sha256(b"x|").hexdigest()[:12]
    assert (row["z"], row["y"], row["c"], row["w"], row["t"]) == ("1234567", "000012", "Galvanized", None, None)


def test_scores(spark):
    sizes = spark.createDataFrame([(1,), (2,), (3,)], "s int").select(S.set_size_uncertainty(F.col("s"), 3)).collect()
    assert [r[0] for r in sizes] == [0.0, 0.5, 1.0]
    row = one(spark, S.set_size_uncertainty(F.lit(1), 1).alias("k"), S.ambiguity(F.lit(0.5)).alias("m"), S.ambiguity(F.lit(1.5)).alias("e"), S.clip(F.lit(None).cast("double"), 0, 1).alias("c"), S.round4(F.lit(0.00005)).alias("r"))
    assert (row["k"], row["m"], row["e"], row["c"], row["r"]) == (0.0, 1.0, 0.0, None, 0.0)


def test_whole_days(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    row = one(
        spark, S.whole_days_between(ts("2020-01-01 23:00:00"), ts("2020-01-03 01:00:00")).alias("a"),
        S.whole_days_between(ts("2020-02-01"), ts("2020-01-01")).alias("b"), S.whole_days_between(F.lit(None).cast("timestamp_ntz"), ts("2020-01-01")).alias("c"),
    )
    assert (row["a"], row["b"], row["c"]) == (1.0, 0.0, 3650.0)


def test_encode_target_stops_on_strays(spark):
    good = spark.createDataFrame([("Lead",), ("Copper",), ("Galvanized",)], "m string")
    assert [r[0] for r in good.select(S.encode_target(F.col("m"))).collect()] == [1, 0, 0]
    with pytest.raises(Exception, match="outside the known set"):
        spark.createDataFrame([("Unknown",)], "m string").select(S.encode_target(F.col("m"))).collect()


def test_priority(spark):
    rows = spark.createDataFrame([(0, 0.9, 0.2, 0.5), (1, 0.1, 0.2, 0.0), (2, 0.5, 0.8, 1.0)], "k int, p double, u double, e double")
    p, u, e = F.col("p"), F.col("u"), F.col("e")
    got = lambda **kw: [r[0] for r in rows.orderBy("k").select(S.priority(p, u, e, **kw)).collect()]
    assert got(strategy="risk") == [0.9, 0.1, 0.5]
    assert got(strategy="uncertainty") == [0.2, 0.2, 0.8]
    assert got(strategy="risk_uncertainty", lambda1=0.5, lambda2=0.5) == pytest.approx([0.55, 0.15, 0.65])
    assert got(strategy="risk_uncertainty_equity", lambda1=0.4, lambda2=0.3, lambda3=0.3) == pytest.approx([0.57, 0.1, 0.74])
    assert got(strategy="oracle") == [0.0, 0.0, 0.0]
    a, b = got(strategy="random", key=F.col("k"), seed=42), got(strategy="random", key=F.col("k"), seed=43)
    assert a != b and a == got(strategy="random", key=F.col("k"), seed=42) and all(0 <= x < 1 for x in a)
    for bad in ({"strategy": "other"}, {"lambda1": 0.9}, {"strategy": "random"}):
        with pytest.raises(ValueError):
            S.priority(p, u, e, **bad)


def test_risk_uncertainty_ranks_like_risk_when_risk_weighs_more_than_twice(spark):
    rows = spark.range(101).select((F.col("id") / 100).alias("p"))
    score = S.priority(F.col("p"), S.ambiguity(F.col("p")), F.lit(0.0), "risk_uncertainty")
    got = [r[0] for r in rows.withColumn("s", score).orderBy("s").select("p").collect()]
    assert got == sorted(got)


def test_distance_and_cells(spark):
    row = one(spark, haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"), haversine_m(F.lit(41.8), F.lit(-87.6), F.lit(41.8), F.lit(-87.6)).alias("zero"))
    assert row["half"] == pytest.approx(6_371_000 * 3.141592653589793) and row["zero"] == 0.0
    near = spark.createDataFrame([(41.8, -87.6), (41.80001, -87.60001), (41.9, -87.6)], "a double, b double")
    cells = [r[0] for r in near.select(hex_cell(F.col("a"), F.col("b"), 500.0, 41.8, -87.6)).collect()]
    assert cells[0] == cells[1] != cells[2]


def test_config():
    cfg = ScoringConfig.from_mapping({"lambda1": 0.5, "active_learning": {"batch_size": 7}, "other": 1})
    assert (cfg.lambda1, cfg.batch_size, cfg.lambda2) == (0.5, 7, 0.25)
    with pytest.raises(ValueError):
        ScoringConfig(confidence_level=1.0)


def test_config_from_yaml():
    pytest.importorskip("yaml")
    text = "lambda1: 0.5\nactive_learning:\n  batch_size: 7\n  n_rounds: 3\nother: [1, 2]\nbudget_scenarios: [1.0, 2.0]\n"
    cfg = ScoringConfig.from_yaml(text)
    assert (cfg.lambda1, cfg.batch_size, cfg.n_rounds, cfg.lambda2) == (0.5, 7, 3, 0.25)
    assert ScoringConfig.from_yaml("") == ScoringConfig()
    with pytest.raises(ValueError, match="mapping"):
        ScoringConfig.from_yaml("- 1\n- 2\n")
    with pytest.raises(ValueError, match="confidence_level"):
        ScoringConfig.from_yaml("confidence_level: 1.0")
