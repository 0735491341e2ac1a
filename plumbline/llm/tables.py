"""Small helpers the operators share: inputs, written intermediate tables, clash-free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import checkpoint_folder


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder, read back with a short lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str):
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
