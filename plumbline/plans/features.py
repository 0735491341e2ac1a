"""Feature tables: label-free base features, and label features that see only a reference set."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.geo import hex_cell
from plumbline.functions.scores import whole_days_between
from plumbline.operators import history, impute, spatial
from plumbline.operators.quality import guard_forbidden
from plumbline.sources.files import write_table

COARSE, FINE = "h3_index_res8", "h3_index_res9"
LABEL_FEATURES = fv.PROCESS + fv.OBSERVED


def add_cells(df: DataFrame, lat0: float, lon0: float, coarse_m: float = fv.COARSE_HEX_EDGE_M, fine_m: float = fv.FINE_HEX_EDGE_M) -> DataFrame:
    here = F.col("latitude"), F.col("longitude")
    return df.withColumns({COARSE: hex_cell(*here, coarse_m, lat0, lon0), FINE: hex_cell(*here, fine_m, lat0, lon0)})


def base_features(
    df: DataFrame, points: DataFrame, lat0: float, lon0: float, fitted: DataFrame | None = None
) -> DataFrame:
    """Imputed columns, hexagon cells and distance to the nearest point. Reads no label.

    `fitted` holds the fill values (by default of `df` itself; pass the training rows' values to keep the
    held-out rows out of them).
    """
    filled = impute.apply(df, impute.fit(df) if fitted is None else fitted)
    placed = add_cells(filled, lat0, lon0)
    return spatial.nearest_distance(placed, points, "dist_to_nearest_hydrant_m", fv.NO_HYDRANT_DISTANCE_M)


def write_base_features(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("ward",)) -> DataFrame:
    """Parquet sink of the base table; a forbidden column stops it."""
    write_table(guard_forbidden(df), path, partition_by)
    return df


def label_features(
    df: DataFrame,
    reference: DataFrame,
    row_id: str,
    label: str = "service_line_material",
    at: str | None = "inspected_at",
    as_of: Column | None = None,
    group: str = "ward",
    k: int = fv.NEIGHBOURS,
    labelled: Column | None = None,
    exclude_self: bool = False,
    wanted: Collection[str] = LABEL_FEATURES,
    late_labels: str = "raise",
) -> DataFrame:
    """Add the `wanted` label features, computed from `reference` alone.

    The label of `df` is sealed under another name while the features are built, so no expression can read
    it. With `as_of`, labels after that time raise (`late_labels="raise"`) or are left out (`"drop"`).
    `exclude_self` keeps a row's own label out of its features when it is part of the reference.
    """
    labelled = F.col(label).isin(*fv.KNOWN_LABELS) if labelled is None else labelled
    positive = F.col(label) == fv.POSITIVE_LABEL
    dated = at is not None and at in reference.columns
    if as_of is not None and dated:
        if late_labels == "drop":
            reference = reference.where(F.col(at).isNull() | (F.col(at) <= as_of))
        else:
            history.assert_visible(reference, at, as_of)
    sealed = df.withColumnRenamed(label, "_sealed") if label in df.columns else df
    out = sealed
    own = None
    if exclude_self:
        own = reference.select(
            row_id, positive.cast("double").alias("_own_y"), labelled.cast("double").alias("_own_l"),
            (F.col(at) if dated else F.lit(None).cast("timestamp_ntz")).alias("_own_at"),
        )
        out = out.join(own.hint("merge"), row_id, "left").na.fill(0.0, ["_own_l"]).withColumn("_own_in", F.col("_own_y").isNotNull().cast("double"))
        out = out.na.fill(0.0, ["_own_y"])

    if "dist_to_nearest_known_lead_m" in wanted:
        known = reference.where(positive)
        if exclude_self:
            joined = spatial.knn_join(out, known, 1, row_id, exclude_self=row_id)
            near = F.get(F.col("neighbours"), 0)["dist"]
            out = joined.withColumn("dist_to_nearest_known_lead_m", F.coalesce(near, F.lit(fv.NO_POSITIVE_DISTANCE_M)))
            out = out.drop("neighbours")
        else:
            out = spatial.nearest_distance(out, known, "dist_to_nearest_known_lead_m", fv.NO_POSITIVE_DISTANCE_M)

    if "neighbor_lead_rate_h3res8" in wanted:
        name = "neighbor_lead_rate_h3res8"
        if exclude_self:
            out = _cell_rate_without_self(out, reference.where(labelled), positive, name)
        else:
            out = spatial.cell_rate(out, reference, COARSE, positive, labelled, name)

    if "knn10_lead_rate" in wanted:
        out = spatial.knn_rate(
            out, reference.where(labelled), k, row_id, positive, "knn10_lead_rate",
            exclude_self=row_id if exclude_self else None,
        )

    grouped = {
        "count": "inspection_count_in_ward", "positives": "known_lead_count_in_ward",
        "rate": "known_lead_rate_in_ward", "last": "_last_in_group",
    }
    if any(n in wanted for n in (*grouped.values(), "days_since_last_inspection_in_ward")):
        stats = history.group_stats(reference, group, positive, at if dated else None, grouped)
        out = out.join(stats, group, "left").na.fill(0.0, [grouped["count"], grouped["positives"], grouped["rate"]])
        if exclude_self:
            n, hits = F.col(grouped["count"]) - F.col("_own_in"), F.col(grouped["positives"]) - F.col("_own_y")
            out = out.withColumns({grouped["count"]: n, grouped["positives"]: hits})
            left, found = F.col(grouped["count"]), F.col(grouped["positives"])
            out = out.withColumn(grouped["rate"], history.rate(found, F.nullif(left, F.lit(0.0))))
            if dated:
                out = _last_without_self(out, reference, group, at)
        if dated:
            now = reference.agg(F.coalesce(F.max(at), F.current_timestamp().cast("timestamp_ntz"))).scalar() if as_of is None else as_of
            days = whole_days_between(F.col("_last_in_group"), now)
        else:
            days = F.lit(float(fv.NO_HISTORY_DAYS))
        out = out.withColumn("days_since_last_inspection_in_ward", days)
    kept = [c for c in sealed.columns] + [f for f in LABEL_FEATURES if f in wanted]
    out = out.select(*kept)
    return out.withColumnRenamed("_sealed", label)


def _last_without_self(df: DataFrame, reference: DataFrame, group: str, at: str) -> DataFrame:
    """Replaces `_last_in_group` of a row that alone holds the group's last time by the time before it."""
    moments = reference.where(F.col(at).isNotNull()).groupBy(group, F.col(at).alias("_at")).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_at")))
    two = moments.withColumn("_r", rank).where("_r <= 2").groupBy(group).agg(
        F.max(F.when(F.col("_r") == 1, F.col("_n"))).alias("_holders"), F.max(F.when(F.col("_r") == 2, F.col("_at"))).alias("_earlier")
    )
    alone = (F.col("_own_at") == F.col("_last_in_group")) & (F.col("_holders") == 1)
    joined = df.join(two, group, "left")
    return joined.withColumn("_last_in_group", F.when(alone, F.col("_earlier")).otherwise(F.col("_last_in_group"))).drop("_holders", "_earlier")


def _cell_rate_without_self(df: DataFrame, known: DataFrame, positive: Column, name: str) -> DataFrame:
    n_hits = [F.count("*").alias("_n"), F.count_if(positive).alias("_h")]
    rates = known.groupBy(COARSE).agg(*n_hits)
    total = known.agg(*n_hits).select(F.struct("_n", "_h")).scalar()

    def share(n: Column, hits: Column) -> Column:
        n, hits = n - F.col("_own_l"), hits - F.col("_own_y")
        return F.when(n > 0, hits / F.nullif(n, F.lit(0.0)))

    joined = df.join(rates, COARSE, "left")
    value = F.coalesce(share(F.col("_n"), F.col("_h")), share(total["_n"], total["_h"]), F.lit(0.0))
    return joined.withColumn(name, value).drop("_n", "_h")
