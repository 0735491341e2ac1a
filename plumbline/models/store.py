"""Model folders: the fitted pipeline next to a one-row metadata table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

METADATA = (
    "model_version string, feature_version string, feature_names array<string>, calibration_method string, "
    "slope double, intercept double, trained_at timestamp, split_metadata string, metrics string"
)


def save_model(
    model: PipelineModel, spark: SparkSession, path: str, version: str, features: Sequence[str],
    split_metadata: Mapping, calibration: tuple[float, float] | None = None, metrics: Mapping | None = None,
    feature_version: str = "v1",
) -> None:
    """Write pipeline and metadata; refused without a split mode, so no model of unknown origin is stored."""
    if not split_metadata.get("split_mode"):
        raise ValueError("refusing to save a model whose metadata lacks split_mode")
    slope, intercept = calibration or (None, None)
    model.write().overwrite().save(f"{path}/pipeline")
    row = (
        version, feature_version, list(features), "sigmoid" if calibration else "none", slope, intercept, None,
        json.dumps(dict(split_metadata), default=str), json.dumps(dict(metrics or {}), default=str),
    )
    meta = spark.createDataFrame([row], METADATA).withColumn("trained_at", F.current_timestamp())
    meta.write.mode("append").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    model = PipelineModel.load(f"{path}/pipeline")
    if model.stages[-1].numClasses != 2:
        raise ValueError("expected the binary classes [0, 1]")
    return model


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).parquet(f"{path}/metadata")


def active_version(spark: SparkSession, path: str) -> DataFrame:
    """The most recently trained version with its features."""
    latest = F.max_by(F.struct("model_version", "feature_names", "calibration_method", "split_metadata"), "trained_at")
    return metadata(spark, path).agg(latest.alias("m"), F.max("trained_at").alias("trained_at")).select("m.*", "trained_at")
