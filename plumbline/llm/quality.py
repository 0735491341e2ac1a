"""Quality classifier by co-training of two views: what a text contains, and what is known about the page.

The content view sees hashed word shares and a few shares of the text (letters, digits, marks, distinct words and
lines). The page view sees source, language and size. Both are logistic regressions. In each round, each view labels
the rows of an unlabelled pool that it is sure of, and the other view is fitted again with these pseudo-labels. Both
are then calibrated on labelled rows that no fit has seen, and their log odds are added (less the prior, which both
contain) to score all documents. A view that knows nothing is calibrated to the prior, teaches nothing and drops out.

Bounds: fits use at most `LABELLED` labelled and `POOL` unlabelled rows, those with the smallest hashes. Everything
else covers all rows: documents are scored in one pass without a shuffle or Python.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.tables import free, text_or_empty, written

LABELLED = 20_000
POOL = 20_000
ROUNDS = 3
SURE = 0.97
THRESHOLD = 0.5
WORD_BUCKETS = 512
PAGE_BUCKETS = 256
STEPS = 60
PARTITIONS = 8
VIEWS = ("content", "page")
SCORES = ("content_score", "page_score", "score")
LEAST_GAIN = 0.02


@dataclasses.dataclass(frozen=True)
class Classifier:
    """One model and one calibration (slope, intercept) per view; `prior` is the log odds of good among labelled rows.
    Without labels of both classes there are no models, and every row gets the share of good labels (1 without any)."""

    models: dict[str, LogisticRegressionModel]
    calibration: dict[str, tuple[float, float]]
    prior: float
    share: float


def _log1p(c: Column) -> Column:
    return F.log1p(c.cast("double"))


def packed(docs: DataFrame, text: str, source: str, lang: str, n_chars: str) -> DataFrame:
    """The rows of `docs` as one struct `row` beside the columns the views read, so that no name can clash."""
    has = lambda c: c in docs.columns
    word = lambda c: F.col(f"`{c}`").cast("string") if has(c) else F.lit(None).cast("string")
    size = F.coalesce(F.col(f"`{n_chars}`").cast("double"), F.lit(-1.0)) if has(n_chars) else F.lit(-1.0)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, text_or_empty(text).alias("body"), word(source).alias("source"), word(lang).alias("lang"), size.alias("size"))


def with_views(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> DataFrame:
    """(row, content, page): the rows of `docs` as structs with both views' vectors.

    Missing columns and nulls count as an unknown value; null text as empty. Very long texts are read whole.
    """
    out = packed(docs, text, source, lang, n_chars)
    body = F.col("body")
    n = F.greatest(F.length(body), F.lit(1)).cast("double")
    words = F.filter(F.split(F.lower(body), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = out.withColumn("words", words)
    kept = lambda pattern: F.length(F.regexp_replace(body, pattern, "")) / n
    letters, digits, plain = kept(r"\P{L}+"), kept(r"[^0-9]+"), kept(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+")
    lines = F.split(body, "\n")
    many = F.greatest(F.size("words"), F.lit(1))
    numbers = F.array(
        letters, digits, 1 - plain, F.size(F.array_distinct("words")) / many, F.size(F.array_distinct(lines)) / F.size(lines),
        F.length(F.array_join("words", "")) / many / 10, _log1p(F.size("words")) / 10,
    )
    out = out.withColumn("numbers", numbers)
    known = [F.concat(F.lit(f"{k}="), F.coalesce(c, F.lit("\0"))) for k, c in (("s", "source"), ("l", "lang"))]
    size = _log1p(F.greatest("size", F.lit(0.0)))
    out = out.withColumns({"tags": F.array(*known, F.concat(F.lit("n="), F.floor(size).cast("string"))), "size": size})
    out = HashingTF(numFeatures=WORD_BUCKETS, inputCol="words", outputCol="tf").transform(out)
    out = Normalizer(p=1.0, inputCol="tf", outputCol="shares").transform(out)
    out = HashingTF(numFeatures=PAGE_BUCKETS, binary=True, inputCol="tags", outputCol="tagged").transform(out)
    out = out.withColumns({f"x{i}": F.col("numbers")[i] for i in range(7)})
    out = VectorAssembler(inputCols=[*(f"x{i}" for i in range(7)), "shares"], outputCol="content").transform(out)
    out = VectorAssembler(inputCols=["size", "tagged"], outputCol="page").transform(out)
    return out.select("row", "content", "page")


def _margin(model: LogisticRegressionModel, view: str, df: DataFrame, name: str) -> DataFrame:
    """Adds the view's log odds of good as `name`, kept within 30 either way."""
    out = model.copy().setFeaturesCol(view).setRawPredictionCol("raw").setProbabilityCol("").setPredictionCol("").transform(df)
    return out.withColumn(name, F.greatest(F.lit(-30.0), F.least(F.lit(30.0), vector_to_array("raw")[1]))).drop("raw")


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def fit_line(margin: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not below 0) and intercept of the log odds of `label` over `margin`, by Newton steps on the logistic loss."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.array([0.0, _log_odds(float(np.clip(label.mean(), 1e-6, 1 - 1e-6)))])
    keep = np.diag([ridge * len(margin), 0.0])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - label) + keep @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep + 1e-9 * np.eye(2), slope)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    if w[0] < 0:
        return 0.0, _log_odds(float(np.clip(label.mean(), 1e-6, 1 - 1e-6)))
    return float(w[0]), float(w[1])


def _loss(odds: np.ndarray, label: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, np.where(label > 0, -odds, odds))))


def _calibrate(models: dict, held: DataFrame) -> tuple[dict[str, tuple[float, float]], dict[str, bool]]:
    """By view: its line over labelled rows that no fit has seen, and whether it then tells more than the share of good.
    The rows are a fifth of at most `LABELLED`; two numbers of each go to the driver."""
    lines, tells = {}, {}
    for v in VIEWS:
        rows = _margin(models[v], v, held, "m").select("m", "label").toArrow()
        margin, label = (rows.column(c).to_numpy() for c in ("m", "label"))
        lines[v] = fit_line(margin, label)
        prior = _log_odds(float(label.mean()))
        tells[v] = _loss(lines[v][0] * margin + lines[v][1], label) < (1 - LEAST_GAIN) * _loss(np.full(len(label), prior), label)
    return lines, tells


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS, sure: float = SURE,
    labelled: int = LABELLED, pool: int = POOL, **columns: str,
) -> Classifier:
    """`labels`: (doc_id, quality); of several labels of an id the lowest counts, null labels and ids are ignored.

    In each round a view teaches the other one the rows it is sure of by calibrated chances, provided that it tells
    held-out rows better than their share of good does. Taught rows weigh as much in all as the labelled ones, and
    good and bad among them as among the labelled ones, however many of each a view is sure of.
    """
    rank = F.xxhash64(F.lit("fit"), "id")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    known = known.agg(F.min((F.col("quality") > 0).cast("double")).alias("label"))
    ids = docs.select(F.col(f"`{doc_id}`").alias("id")).where("id IS NOT NULL").distinct()
    found = written(known.join(ids, "id").orderBy(rank).limit(labelled), "labelled")
    free_ids = ids.join(known.select("id"), "id", "left_anti").orderBy(rank).limit(pool)
    wanted = found.unionByName(free_ids.withColumn("label", F.lit(None).cast("double")))
    # at most labelled + pool ids, whatever the input
    rows = docs.join(F.broadcast(wanted.select(F.col("id").alias(free(docs, "wanted")))), F.col(f"`{doc_id}`") == F.col(free(docs, "wanted")), "left_semi")
    rows = with_views(rows, text, **columns).withColumn("id", F.col("row")[doc_id]).dropDuplicates(["id"])
    rows = rows.select("id", "content", "page").join(F.broadcast(wanted), "id")
    # a bounded table: few partitions, which the fits go over again and again
    rows = rows.withColumns({"held": F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(5)) == 0, "weight": F.lit(1.0)}).repartition(PARTITIONS, "id")
    rows = written(rows, "views")
    counts = {(r["label"], r["held"]): r["count"] for r in rows.where("label IS NOT NULL").groupBy("label", "held").count().collect()}
    n = sum(counts.values())
    share = sum(v for (k, _), v in counts.items() if k > 0) / n if n else 1.0
    if any((k, held) not in counts for k in (0.0, 1.0) for held in (False, True)):
        return Classifier({}, {}, 0.0, share)
    train, held = rows.where("label IS NOT NULL AND NOT held"), rows.where("label IS NOT NULL AND held")
    labelled_as = {k: counts[k, False] for k in (0.0, 1.0)}
    unlabelled = rows.where("label IS NULL")
    regression = lambda view: LogisticRegression(featuresCol=view, labelCol="label", weightCol="weight", maxIter=STEPS, regParam=1e-4)
    models = {v: regression(v).fit(train) for v in VIEWS}
    lines, tells = _calibrate(models, held)
    for _ in range(rounds):
        taught = dict.fromkeys(VIEWS, train)
        for v, other in (VIEWS, VIEWS[::-1]):
            if not tells[v]:
                continue
            chance = _chance(F.lit(lines[v][0]) * F.col("m") + F.lit(lines[v][1]))
            label = F.when(chance >= sure, 1.0).when(chance <= 1 - sure, 0.0)
            pseudo = _margin(models[v], v, unlabelled, "m").withColumn("label", label).where("label IS NOT NULL").select(*rows.columns)
            pseudo = written(pseudo, "taught")
            many = {r["label"]: r["count"] for r in pseudo.groupBy("label").count().collect()}
            if len(many) == 2:  # one class alone would only move the share
                weight = F.when(F.col("label") > 0, labelled_as[1.0] / many[1.0]).otherwise(labelled_as[0.0] / many[0.0])
                taught[other] = train.unionByName(pseudo.withColumn("weight", F.least(F.lit(1.0), weight)))
        models = {v: regression(v).fit(taught[v]) for v in VIEWS}
        lines, tells = _calibrate(models, held)
    good = counts[1.0, True] / (counts[1.0, True] + counts[0.0, True])
    return Classifier(models, lines, _log_odds(good), share)


def _log_odds(p: float) -> float:
    return math.log(p / (1 - p))


def _scored(docs: DataFrame, classifier: Classifier, text: str, columns: dict[str, str]) -> DataFrame:
    """(row, content_score, page_score, score)."""
    out = with_views(docs, text, **columns)
    for v in VIEWS:
        out = _margin(classifier.models[v], v, out, f"m_{v}").drop(v)
    odds = [F.lit(slope) * F.col(f"m_{v}") + F.lit(intercept) for v, (slope, intercept) in ((v, classifier.calibration[v]) for v in VIEWS)]
    both = odds[0] + odds[1] - F.lit(classifier.prior)
    return out.select("row", *(_chance(x).alias(c) for c, x in zip(SCORES, (*odds, both))))


def score(docs: DataFrame, classifier: Classifier, text: str = "text", **columns: str) -> DataFrame:
    """`docs` plus content_score, page_score and score: calibrated probabilities of good, by view and combined.

    Rows are scored one by one: repeated rows repeat, ids play no part, an empty table gives an empty result. Columns
    of `docs` with these names are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in SCORES])
    if not classifier.models:
        return docs.withColumns({c: F.lit(float(classifier.share)) for c in SCORES})
    return _scored(docs, classifier, text, columns).select("row.*", *SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", **columns) -> DataFrame:
    """The rows of `docs` whose score reaches `threshold`, columns as they were; all of them where labels of both classes
    are missing and no model can be fitted."""
    names = {k: columns.pop(k) for k in ("source", "lang", "n_chars") if k in columns}
    classifier = fit(docs, labels, text, doc_id, **columns, **names)
    if not classifier.models:
        return docs
    return _scored(docs, classifier, text, names).where(F.col("score") >= threshold).select("row.*")
