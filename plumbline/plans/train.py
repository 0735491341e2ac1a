"""Training, calibration, conformal and explanation jobs over one shared split and feature table."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fv
from plumbline.config import TrainConfig
from plumbline.functions.scores import cutoff_heuristic, example_weight, nonconformity
from plumbline.models import pipelines as ml, store
from plumbline.models.attributions import tree_attributions
from plumbline.models.calibration import apply_sigmoid, fit_sigmoid
from plumbline.operators import impute
from plumbline.operators.conformal import check_alpha, coverage, group_thresholds, thresholds, with_threshold
from plumbline.operators.equity import with_quartile
from plumbline.operators.explain import global_importance, top_contributions
from plumbline.operators.metrics import compute_metrics, improvement_gate, profile_metrics, score_profile
from plumbline.operators.splits import inner_validation, split_dataset
from plumbline.plans.features import LABEL_FEATURES, label_features
from plumbline.session import stage


@dataclasses.dataclass
class Prepared:
    """Labelled rows with split and features, computed once for every consumer."""

    rows: DataFrame
    metadata: DataFrame
    features: tuple[str, ...]
    row_id: str
    label: str

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)

    def matrix(self, name: str, features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
        return ml.training_matrix(self.part(name), features or self.features, self.label, [self.row_id, ml.EXAMPLE, *keep])

    @property
    def weight(self) -> str | None:
        return ml.EXAMPLE if ml.EXAMPLE in self.rows.columns else None


def prepare(
    base: DataFrame, mode: str, features: Sequence[str], row_id: str = "property_id", label: str = "service_line_material",
    cutoff: str | None = None, exclude_self: bool = True, min_test_rows: int | None = 100, key: Column | None = None,
    source_weights: Mapping[str, float] | None = None, source: str = "material_source", **split: object,
) -> Prepared:
    """Split the labelled rows, fill gaps with values of the training rows, then build label features from the
    training rows for all parts in one pass.

    `source_weights` says how much a row of each label source counts (others and null: 1) in fits, calibration and
    metrics of everything that is built on the result.
    """
    if source_weights:
        base = base.withColumn(ml.EXAMPLE, example_weight(F.col(source), source_weights))
    known = F.col(label).isin(*fv.KNOWN_LABELS)
    rows, meta = split_dataset(
        base, mode, row_id, label, known, cutoff=cutoff, min_test_rows=min_test_rows, key=key, **split
    )
    rows = stage(impute.apply(rows, impute.fit(rows.where(F.col("split") == "train"))))
    n = rows.count()
    wanted = [f for f in features if f in LABEL_FEATURES]
    if wanted:
        as_of = F.lit(cutoff).cast("timestamp_ntz") if cutoff else None
        train = rows.where(F.col("split") == "train")
        rows = label_features(rows, train, row_id, label, as_of=as_of, exclude_self=exclude_self, wanted=wanted)
    return Prepared(stage(ml.dealt(rows, n)), meta, tuple(features), row_id, label)


def baseline_metrics(data: Prepared, cfg: TrainConfig = TrainConfig(), features: Sequence[str] | None = None) -> DataFrame:
    """Test metrics of the year heuristic, logistic regression and random forest: one row per model."""
    features = features or data.features
    train, test = data.matrix("train", features), data.matrix("test", features)
    scored = {"heuristic": test.withColumn("p_lead", cutoff_heuristic(F.col("year_built")))}
    scored["logistic_regression"] = ml.score(ml.fit_logistic(train, features, cfg), test)
    scored["random_forest"] = ml.score(ml.fit_forest(train, features, cfg), test)
    out = None
    for name, rows in scored.items():
        one = compute_metrics(rows, ml.LABEL, "p_lead", data.row_id).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@dataclasses.dataclass
class Trained:
    model: PipelineModel
    calibration: tuple[float, float]
    features: tuple[str, ...]
    trials: DataFrame | None = None

    def score(self, df: DataFrame, name: str = "p_lead") -> DataFrame:
        """Calibrated probability; the uncalibrated one stays in `p_raw`."""
        raw = ml.score(self.model, df, "p_raw")
        return raw.withColumn(name, apply_sigmoid(F.col("p_raw"), *self.calibration))


def train_boosted(data: Prepared, cfg: TrainConfig = TrainConfig(), search: bool = False, mode: str = "geographic", key: Column | None = None) -> Trained:
    """Fit boosted trees on the training rows (early stopping on calibration rows), calibrate on CAL."""
    features, trials, tuned = data.features, None, {}
    if search:
        marked = inner_validation(data.part("train"), data.row_id, mode, seed=cfg.seed, key=key)
        parts = [ml.training_matrix(marked.where(c), features, data.label, [ml.EXAMPLE]) for c in ("not is_validation", "is_validation")]
        best, trials = ml.search_boosted(*parts, features, cfg)
        cfg = dataclasses.replace(cfg, max_depth=best["max_depth"], learning_rate=best["learning_rate"], subsample=best["subsample"])
        tuned = {"min_instances": best["min_instances"], "feature_share": best["feature_share"]}
    train = data.matrix("train").withColumn(ml.VALIDATION, F.lit(False))
    watch = data.matrix("calibration").withColumn(ml.VALIDATION, F.lit(True))
    model = ml.fit_boosted(train.unionByName(watch), features, cfg, early_stopping=True, **tuned)
    calibration = fit_sigmoid(ml.score(model, data.matrix("calibration"), "p_raw"), "p_raw", ml.LABEL, data.weight)
    return Trained(model, calibration, features, trials)


def evaluate(trained: Trained, data: Prepared, baseline_ap: float | None = None) -> DataFrame:
    """Test metrics of the calibrated model, with the gate against a baseline when one is given."""
    out = compute_metrics(trained.score(data.matrix("test")), ml.LABEL, "p_lead", data.row_id, weight=data.weight)
    if baseline_ap is None:
        return out
    return improvement_gate(out.withColumn("_b", F.lit(baseline_ap)), "pr_auc", "_b").drop("_b")


def propensity(
    df: DataFrame, features: Sequence[str], row_id: str, label: str, cfg: TrainConfig, key: Column | None = None,
    path: str | None = None, version: str = "propensity",
) -> DataFrame:
    """How predictable it is that a row was inspected at all: metrics on a stratified fifth of the rows.

    With `path` the model goes to the model store there, with how its rows were split and its metrics.
    """
    from plumbline.functions.scores import is_known
    from plumbline.operators.splits import random_split

    seen = df.withColumn(ml.LABEL, is_known(F.col(label)).cast("double"))
    parted = stage(random_split(seen, row_id, F.col(ml.LABEL), test=0.2, calibration=0.0, key=key))
    parted = stage(ml.dealt(impute.apply(parted, impute.fit(parted.where("split = 'train'"))), parted.count()))
    model = ml.fit_boosted(parted.where("split = 'train'"), features, cfg)
    scored = ml.score(model, parted.where("split = 'test'"), "p_seen")
    out = compute_metrics(scored, ml.LABEL, "p_seen", row_id).withColumn("baseline", F.col("n_pos") / F.col("n"))
    if path is None:
        return out
    out = stage(out)
    split = {"split_mode": "random_stratified", "test_fraction": 0.2, "target": "inspected", "seed": cfg.seed}
    store.save_model(model, df.sparkSession, path, version, features, split, metrics=out.first().asDict())
    return out


def conformal_report(
    calibration: DataFrame, test: DataFrame, y: str = "y", p: str = "p_lead", group: str = "income_quartile", alpha: float = 0.10
) -> DataFrame:
    """Coverage and set sizes on test rows under the global and the per-group thresholds.

    One row for the global predictor (group null) and one per group.
    """
    check_alpha(alpha)
    scored = [d.withColumn("score", nonconformity(F.col(y), F.col(p))) for d in (calibration, test)]
    cal, held = stage(scored[0]), scored[1]
    overall = thresholds(cal, "score", alpha).select("threshold").scalar()
    world = held.withColumn("threshold", overall)
    per_group = with_threshold(held, group_thresholds(cal, "score", group, alpha=alpha), group)
    columns = [group, "n", "coverage", "mean_set_size", "mean_served_size", "threshold"]
    first = coverage(world, "score", p).withColumn("threshold", overall).withColumn(group, F.lit(None).cast("int"))
    rest = coverage(per_group, "score", p, (group, "threshold"))
    return first.select(*columns).unionByName(rest.select(*columns)).withColumn("target_coverage", F.lit(1 - alpha))


def conformal_job(
    spark: SparkSession, path: str, data: Prepared, reference: DataFrame, area: str = "census_tract", alpha: float = 0.10
) -> DataFrame:
    """From the stored model to its report: calibrated scores of calibration and test rows, thresholds from the former
    (global and per quartile of the area's value in `reference`), coverage on the latter."""
    model, active = store.load_model(spark, path), store.metadata(spark, path).orderBy(F.desc("trained_at")).first()
    if active["calibration_method"] != "sigmoid":
        raise ValueError("conformal sets need a calibrated model")
    trained = Trained(model, (active["slope"], active["intercept"]), tuple(active["feature_names"]))
    scored = [trained.score(data.matrix(part, trained.features, [area])) for part in ("calibration", "test")]
    cal, test = (with_quartile(d, reference, area) for d in scored)
    return conformal_report(cal, test, ml.LABEL, alpha=alpha)


def explanation_tables(trained: Trained, data: Prepared, top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Attributions of the uncalibrated margin on TEST: top contributions per row, and global importance."""
    rows = stage(tree_attributions(trained.model, data.matrix("test"), trained.features, data.row_id))
    top = rows.select(data.row_id, top_contributions(F.col("attributions"), top_n).alias("top_features"))
    return top, global_importance(rows, "attributions")


def ablation(base: DataFrame, folds: Sequence[dict], sets: Sequence[str], cfg: TrainConfig = TrainConfig(), **kw: object) -> DataFrame:
    """Average precision of boosted trees and of the heuristic per fold and feature set.

    A fold is the keyword arguments of `prepare` plus a `name`. Features are built once per fold, for the
    union of the sets. A set with a feature that the table does not have stops the job. Folds are built, and then all
    fits made, as concurrent jobs, `parallel_trials` at a time: one fit alone is mostly short jobs that leave cores idle.
    """
    spark = base.sparkSession
    union = list(dict.fromkeys(f for s in sets for f in fv.FEATURE_SETS[s]))

    def prepared(fold: dict) -> tuple[Prepared, float]:
        data = prepare(base, features=union, **{k: v for k, v in fold.items() if k != "name"}, **kw)
        plain = data.matrix("test").withColumn("p_lead", cutoff_heuristic(F.col("year_built")))
        return data, profile_metrics(score_profile(plain, ml.LABEL, "p_lead")).first()["pr_auc"]

    def fitted(task: tuple[Prepared, str]) -> float:
        narrowed = dataclasses.replace(task[0], features=fv.FEATURE_SETS[task[1]])
        scored = train_boosted(narrowed, cfg).score(narrowed.matrix("test"))
        return profile_metrics(score_profile(scored, ml.LABEL, "p_lead", weight=narrowed.weight)).first()["pr_auc"]

    with ThreadPoolExecutor(max(1, cfg.parallel_trials)) as pool:
        threaded = inheritable_thread_target(spark)
        data = list(pool.map(threaded(prepared), folds))
        tasks = [(fold["name"], name, *built) for fold, built in zip(folds, data) for name in sets]
        found = list(pool.map(threaded(fitted), [(built, name) for _, name, built, _ in tasks]))
    results = []
    for (fold, name, _, plain), value in zip(tasks, found):
        results += [(fold, name, "boosted", value), (fold, name, "heuristic", plain)]
    return spark.createDataFrame(results, "fold string, feature_set string, model string, pr_auc double")
