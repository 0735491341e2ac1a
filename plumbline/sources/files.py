"""File scans and sinks. Text sources are read as strings and coerced later, never inferred."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.text import canonical, to_number

INSPECTION_LOG = (
    "inspection_id string, property_id string, inspected_material string, inspected_at string, "
    "source string, cost_usd double, census_tract string, used_in_training boolean"
)


def read_csv_strings(spark: SparkSession, path: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """All columns as strings, header names trimmed and renamed; unknown columns are kept."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=False)
    names = {c: (rename or {}).get(c.strip(), c.strip()) for c in raw.columns}
    return raw.withColumnsRenamed(names)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv_strings(spark, path, fv.INVENTORY_COLUMNS)
    numbers = {"latitude": "double", "longitude": "double", "ward": "bigint"}
    out = {
        c: to_number(F.col(c) if c in df.columns else F.lit(None).cast("string"), kind) for c, kind in numbers.items()
    }
    if "service_line_material" in df.columns:
        out["service_line_material"] = canonical(F.col("service_line_material"))
    return df.withColumns(out)


def read_assessor(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv_strings(spark, path, fv.ASSESSOR_COLUMNS)
    numbers = ("year_built", "lot_size_sqft", "building_sqft", "stories")
    out = {c: to_number(F.col(c)) for c in numbers if c in df.columns}
    if "has_basement" not in df.columns:
        out["has_basement"] = F.lit(False)
    return df.withColumns(out)


def read_parquet_folder(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """Every Parquet file of a folder as one table; `merge` unites differing schemas."""
    return spark.read.option("mergeSchema", str(merge).lower()).parquet(path)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to unite")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_point_elements(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Points from nested JSON {"elements": [{"lat", "lon"}]}, elements without `lat` left out.

    A missing file is an error. A file read as `one_document` is one record for Spark; a large extract should
    come as one document per line (`one_document=False`) so that it can be split.
    """
    schema = "elements array<struct<lat:double,lon:double>>"
    try:
        raw = spark.read.schema(schema).json(path, multiLine=one_document)
    except AnalysisException as e:
        raise FileNotFoundError(f"missing required spatial reference: {path}") from e
    points = raw.select(F.inline("elements")).where(F.col("lat").isNotNull())
    return points.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


def read_income(spark: SparkSession, path: str) -> DataFrame:
    """Area incomes: header in the first row, suppressed (non-positive) and unreadable values dropped."""
    from plumbline.functions.text import tract_key

    df = read_csv_strings(spark, path)
    if fv.INCOME_COLUMN not in df.columns:
        raise ValueError(f"expected column {fv.INCOME_COLUMN}; got {df.columns}")
    income = to_number(F.col(fv.INCOME_COLUMN))
    return df.select(tract_key(F.col("tract")).alias("census_tract"), income.alias("income")).where("income > 0")


def read_inspections(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log; blank lines carry no record."""
    return spark.read.schema(INSPECTION_LOG).json(path)


def append_inspections(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        # brings the rows of a value together and splits a hot value by size, so that files are few and tasks even
        writer = df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as JSON."""
    df.repartition(1).write.mode("overwrite").json(path)


def write_curve(df: DataFrame, path: str) -> None:
    df.repartition(1).write.mode("overwrite").csv(path, header=True)
