"""Co-training: held-out accuracy, exchange between the views, and odd tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality
from plumbline.llm.queries import QUERIES


def test_query_on_labels_it_was_not_fitted_on(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # a few hundred labels
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    test = F.pmod(F.xxhash64(F.lit("test"), "doc_id"), F.lit(3)) == 0
    model = quality.fit(docs, labels.where(~test))
    rows = quality.score(docs, model).join(labels.where(test), "doc_id").select("score", F.col("quality")).collect()
    right = sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows)
    assert len(rows) > 20 and right >= 0.93 * len(rows)
    good = [r for r in rows if r.quality == 1]
    assert sum(r.score >= quality.THRESHOLD for r in good) >= 0.97 * len(good)


def test_query_scores_every_document(spark, sf):
    out = QUERIES["op4_quality_cotraining"](spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= quality.THRESHOLD) for r in out)


def test_calibration_line():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * x - 0.7)))).astype(float)
    slope, intercept = quality.fit_line(x, y, 0.0)
    assert abs(slope - 1.5) < 0.08 and abs(intercept + 0.7) < 0.08
    assert quality.fit_line(-x, y)[0] == 0.0
    assert all(np.isfinite(quality.fit_line(np.array([-30.0, 30.0] * 20), np.array([0.0, 1.0] * 20))))


def test_labels_that_are_mostly_bad_keep_what_the_models_say(spark):
    """Names of every internal column as columns of the user, and a user's own scores."""
    docs = corpus(spark)
    names = ["row", "body", "words", "numbers", "tags", "size", "tf", "shares", "tagged", "x0", "x6", "content", "page", "raw", "m", "id", "label", "held", "weight", "wanted", "m_page"]
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names} | {"content_score": F.lit(-5.0), "page_score": F.lit(-6.0)})
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality")).where("quality = 0 OR doc_id < 60")
    out = quality.keep_good(docs, labels)
    assert out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and all(r.content_score == -5.0 and r.page_score == -6.0 and all(r[c] == f"own {c}" for c in names) for r in rows)
    assert quality.keep_good(docs, labels.where("quality = 0")).count() == docs.count()


def corpus(spark):
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = " ".join(f"word{(i * 7 + j * j) % 97}" for j in range(30)) if good else "spam !!! " * 20
        rows.append((i, text if i % 40 else text[:60], "en", "good.org" if good else "bad.org", 100 + i, "clash", 1.0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _words string, score double")


def test_a_view_learns_from_the_other(spark):
    """Only the content tells the classes among the labelled rows; pseudo-labels teach the page view about new sources."""
    docs = corpus(spark).withColumn("source", F.when(F.col("doc_id") < 80, "old").otherwise(F.col("source"))).drop("score", "_words")
    labels = docs.where("doc_id < 80").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    page = lambda m: {r.source: r.p for r in quality._margin(m.models["page"], "page", quality.with_views(docs), "m").groupBy("row.source").agg(F.avg("m").alias("p")).collect()}
    alone, taught = (page(quality.fit(docs, labels, rounds=r, sure=0.9)) for r in (0, 2))
    assert taught["good.org"] - taught["bad.org"] > alone["good.org"] - alone["bad.org"] + 1


def test_keep_good_keeps_columns_and_clean_rows(spark):
    docs = corpus(spark)
    odd = spark.createDataFrame([(None, None, None, None, None, "x", None), (7001, "", None, None, None, None, 2.0), (7001, "", None, None, None, None, 2.0)], docs.schema)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    labels = labels.unionByName(labels.limit(9)).unionByName(spark.createDataFrame([(None, 1), (3, None), (99999, 0)], labels.schema))
    out = quality.keep_good(docs.unionByName(odd), labels)
    assert out.dtypes == docs.dtypes
    kept = {r.doc_id for r in out.collect()}
    assert {i for i in range(240) if i % 3} <= kept and not {i for i in range(240) if i % 3 == 0} & kept


def test_no_labels_one_class_and_empty_tables(spark):
    docs = corpus(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).count() == 240
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality.keep_good(docs, ones).count() == 240
    assert quality.keep_good(docs.limit(0), ones).collect() == []
    few = docs.select("doc_id", "text")
    assert quality.score(few, quality.fit(few, none)).where("score = 1").count() == 240


def test_fits_run_for_the_full_rounds_and_steps(spark, monkeypatch):
    fits, plain = [], quality.LogisticRegression
    monkeypatch.setattr(quality, "LogisticRegression", lambda **options: fits.append(options) or plain(**options))
    docs = corpus(spark).drop("score", "_words")
    labels = docs.where("doc_id < 120").select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    quality.fit(docs, labels)
    assert len(fits) == 2 * (1 + 3)  # calibration lines are fitted by Newton steps of their own
    assert all(f["maxIter"] == 60 and f.get("tol", 1e-6) == 1e-6 for f in fits)
