"""From raw inventories to the validated interim table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.text import label_source, normalise_text, stable_id
from plumbline.operators.ordered import first_by
from plumbline.operators.quality import INTERIM, validate, with_columns
from plumbline.session import stage

ASSESSOR_FIELDS = ("pin", "year_built", "property_class", "lot_size_sqft", "building_sqft", "stories", "has_basement")


def join_assessor(inventory: DataFrame, assessor: DataFrame | None) -> DataFrame:
    """Left join on the normalised address; an address with several assessor rows fans out."""
    if assessor is None:
        return inventory
    keyed = assessor.select(
        normalise_text(F.col("address")).alias("_addr"), *[c for c in ASSESSOR_FIELDS if c in assessor.columns]
    ).where("_addr is not null")
    return inventory.withColumn("_addr", normalise_text(F.col("address"))).join(keyed, "_addr", "left").drop("_addr")


def drop_unplaced(df: DataFrame, name: str = "unplaced") -> DataFrame:
    """Drop rows without coordinates; the dropped count is observable under `name`."""
    bad = F.col("latitude").isNull() | F.col("longitude").isNull()
    return df.observe(name, F.count_if(bad).alias("n_dropped")).where(~bad)


def clean(
    inventory: DataFrame, assessor: DataFrame | None = None, order: tuple[Column, ...] = (), updated: Column | None = None
) -> DataFrame:
    """Join, identify, place, deduplicate, label the source and validate.

    `order` decides which of several rows with one id is kept; it defaults to all non-key columns, since a
    distributed table has no file order.
    """
    df = join_assessor(inventory, assessor)
    df = with_columns(
        df,
        {
            "pin": ("string", ""), "zip_code": ("string", None), "ward": ("int", 0), "latitude": ("double", None),
            "longitude": ("double", None), "property_type": ("string", None), "service_line_material": ("string", None),
            "year_built": ("double", None), "property_class": ("string", None), "lot_size_sqft": ("double", None),
            "building_sqft": ("double", None), "stories": ("double", None), "has_basement": ("boolean", False),
            "census_tract": ("string", None), "inspected_at": ("timestamp_ntz", None),
        },
    )
    df = df.withColumn("property_id", stable_id(normalise_text(F.col("address")), F.col("pin")))
    df = drop_unplaced(df)
    order = order or tuple(F.col(c) for c in sorted(df.columns) if c != "property_id")
    df = first_by(df, ["property_id"], order)
    given = F.col("material_source") if "material_source" in df.columns else F.lit(None)
    df = df.withColumn(
        "material_source", F.coalesce(given, label_source(F.col("service_line_material"), F.col("property_type")))
    )
    stamp = F.current_timestamp().cast("timestamp_ntz") if updated is None else updated
    # staged, so that the rules and the consumer read the finished rows instead of redoing the job
    return validate(stage(df.withColumn("last_updated", stamp)), INTERIM)
