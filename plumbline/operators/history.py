"""What was known about a group at a point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scores import whole_days_between
from plumbline.operators.ordered import running_totals


def rate(positives: Column, rows: Column) -> Column:
    return F.when(rows > 0, positives / rows).otherwise(0.0)


def group_stats(reference: DataFrame, group: str, positive: Column, at: str | None, names: dict[str, str]) -> DataFrame:
    """Count, positive count, rate and last time per group, in one aggregation.

    `names` maps count / positives / rate / last to output columns.
    """
    n, hits = F.count("*").cast("double"), F.count_if(positive).cast("double")
    last = F.max(at) if at else F.lit(None).cast("timestamp_ntz")
    return reference.groupBy(group).agg(
        n.alias(names["count"]),
        hits.alias(names["positives"]),
        rate(hits, n).alias(names["rate"]),
        last.alias(names["last"]),
    )


def as_of_history(df: DataFrame, group: str, at: str, positive: Column, labelled: Column) -> DataFrame:
    """Per row: labelled count, positives and last labelled time in its group strictly before its own time.

    Every row stays: one without a time or a group has no history (0, 0, null) and adds to none. Rows of one
    (group, time) are collapsed first and running sums go through ranges, so neither a hot group nor a hot
    timestamp is collected into one task.
    """
    timed = df.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    placed = F.col("_t").isNotNull() & F.col(group).isNotNull()
    known, unplaced = timed.where(placed), timed.where(~placed)
    moments = known.groupBy(group, "_t").agg(
        F.count_if(labelled).alias("prior_count"), F.count_if(labelled & positive).alias("prior_positives")
    )
    moments = moments.withColumn("_hit", F.when(F.col("prior_count") > 0, 1).otherwise(0))
    totals = ["prior_count", "prior_positives", "_hit"]
    before = running_totals(moments, "_t", totals, [group])
    # the last labelled time before a moment is the time of the moment that was the `_hit_before`-th hit
    hits = before.where("_hit = 1").select(
        group, (F.col("_hit_before") + 1).alias("_hit_before"), F.col("_t").alias("prior_last_us")
    )
    keyed = before.select(
        group, "_t", "_hit_before", *[F.col(f"{c}_before").alias(c) for c in totals if c != "_hit"]
    )
    keyed = keyed.join(hits, [group, "_hit_before"], "left").drop("_hit_before")
    none = {"prior_count": F.lit(0).cast("long"), "prior_positives": F.lit(0).cast("long"), "prior_last_us": F.lit(None).cast("long")}
    return known.join(keyed, [group, "_t"]).drop("_t").unionByName(unplaced.withColumns(none).drop("_t"))


def days_since_last(
    df: DataFrame, reference: DataFrame, group: str, at: str, as_of: Column, name: str, missing: int
) -> DataFrame:
    """Days from the group's last event at or before `as_of`; `missing` where there is none."""
    last = reference.where(F.col(at) <= as_of).groupBy(group).agg(F.max(at).alias("_last"))
    joined = df.join(last, group, "left")
    return joined.withColumn(name, whole_days_between(F.col("_last"), as_of, missing)).drop("_last")


def assert_visible(reference: DataFrame, at: str, as_of: Column) -> None:
    """Raise when the reference holds a label later than the prediction time."""
    late = reference.where(F.col(at) > as_of).agg(F.max(at)).first()[0]
    if late is not None:
        raise ValueError(f"reference holds labels up to {late}, after the prediction time")


def visible(reference: DataFrame, at: str, as_of: Column) -> DataFrame:
    """Filter mode of the same rule: labels after `as_of` (or undated) are left out."""
    return reference.where(F.col(at) <= as_of)


def cumulative(df: DataFrame, order: str, totals: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Running sums before each row per group (rounds of a back-test)."""
    return running_totals(df, order, totals, by)
