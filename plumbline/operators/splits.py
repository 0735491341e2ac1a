"""Leakage-safe splits, expressed as one `split` column: train, calibration, test (null = unused)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.scores import unit_hash
from plumbline.operators.ordered import global_rank, hash_rank, null_safe_join, running_totals
from plumbline.session import stage

MODES = ("random", "geographic", "temporal", "spatial-temporal")
HOLDOUT_SHARE = 0.25
PART_SHARE = 0.15


def random_split(
    df: DataFrame, row_id: str, stratum: Column, test: float = PART_SHARE, calibration: float = PART_SHARE,
    seed: int = fv.SEED, key: Column | None = None,
) -> DataFrame:
    """Stratified: within each stratum (null is one) the rows are ranked by hash and cut at exact counts."""
    key = unit_hash(F.col(row_id), seed) if key is None else key
    rows = df.withColumn("_stratum", stratum)
    ranked = hash_rank(rows, key, row_id, ["_stratum"], "_rank")
    sizes = rows.groupBy("_stratum").agg(F.count("*").alias("_n"))
    joined = null_safe_join(ranked, sizes, ["_stratum"])
    n_test = F.round(F.col("_n") * test)
    n_cal = F.round(F.col("_n") * calibration)
    part = (
        F.when(F.col("_rank") <= n_test, "test")
        .when(F.col("_rank") <= n_test + n_cal, "calibration")
        .otherwise("train")
    )
    return joined.withColumn("split", part).drop("_stratum", "_rank", "_n")


def holdout_groups(df: DataFrame, group: str, seed: int = fv.SEED, key: Column | None = None) -> DataFrame:
    """Groups drawn by hash order for calibration and test: (group, part).

    A quarter of the groups (at least one) is held out; the first half of those, at least one, calibrates
    and the rest tests, so a single held-out group leaves the test part empty.
    """
    key = unit_hash(F.col(group), seed) if key is None else key
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    ranked = hash_rank(groups, key, group, name="_rank")
    total = groups.agg(F.count("*")).scalar()
    held = F.greatest(F.lit(1), F.floor(total * HOLDOUT_SHARE))
    n_cal = F.greatest(F.lit(1), F.floor(held / 2))
    part = F.when(F.col("_rank") <= n_cal, "calibration").otherwise("test")
    return ranked.where(F.col("_rank") <= held).select(group, part.alias("_part"))


def listed_groups(df: DataFrame, group: str, holdout: Sequence) -> DataFrame:
    """The same, from an explicit ordered list."""
    n_cal = max(1, len(holdout) // 2)
    rows = [(g, "calibration" if i < n_cal else "test") for i, g in enumerate(holdout)]
    kind = df.schema[group].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"{group} {kind}, _part string")


def greedy_groups(df: DataFrame, group: str, share: float = PART_SHARE) -> DataFrame:
    """Largest groups first: to test while test holds less than `share` of the rows, then to calibration."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    ranked = global_rank(counts, [F.desc("_n"), F.asc(group)], "_rank")
    cut = running_totals(ranked, "_rank", ["_n"])
    limit = cut.agg(F.sum("_n")).scalar() * share
    in_test = F.col("_n_before") < limit
    n_test = cut.where(in_test).agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    part = F.when(in_test, "test").when(F.col("_n_before") - n_test < limit, "calibration")
    return cut.select(group, part.alias("_part")).where(F.col("_part").isNotNull())


def by_groups(df: DataFrame, group: str, parts: DataFrame) -> DataFrame:
    """Rows of listed groups take their part, all others (also a null group) train."""
    return df.join(parts, group, "left").withColumn("split", F.coalesce("_part", F.lit("train"))).drop("_part")


def _future_part(at: Column, start: Column | None, end: Column | None) -> Column:
    return F.when(at < start, "calibration").when((at >= start) & (at < end), "test")


def temporal_split(
    df: DataFrame, at: str, cutoff: Column, row_id: str, test_start: Column | None = None, test_end: Column | None = None
) -> DataFrame:
    """Train before the cutoff. After it: calibration up to `test_start`, test in [test_start, test_end);
    without those bounds the later rows are halved in time order (ties by id). Undated rows have no part."""
    when = F.col(at)
    if test_start is not None and test_end is not None:
        part = F.when(when < cutoff, "train").when(when >= cutoff, _future_part(when, test_start, test_end))
        return df.withColumn("split", part)
    # only a row that is surely later takes part in the halving
    rest = df.where(~F.coalesce(when >= cutoff, F.lit(False)))
    past = rest.withColumn("split", F.when(when < cutoff, "train"))
    future = global_rank(df.where(when >= cutoff), [F.asc(at), F.asc(row_id)], "_rank")
    half = F.floor(future.agg(F.count("*")).scalar() / 2)
    part = F.when(F.col("_rank") <= half, "calibration").otherwise("test")
    return past.unionByName(future.withColumn("split", part).drop("_rank"))


def spatial_temporal_split(df: DataFrame, group: str, at: str, cutoff: Column, parts: DataFrame) -> DataFrame:
    """Train on past rows of seen groups, calibrate and test on later rows of unseen ones."""
    past, later = F.col(at) < cutoff, F.col(at) >= cutoff
    part = F.when(F.col("_part").isNull() & past, "train").when(later, F.col("_part"))
    return df.join(parts, group, "left").withColumn("split", part).drop("_part")


def split_metadata(
    df: DataFrame, mode: str, at: str | None = None, group: str | None = None, min_test_rows: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row (or one per `by`): sizes, number of held-out groups, boundary times and the sample status."""
    here = lambda part: F.col("split") == part
    columns = [F.lit(mode).alias("split_mode"), F.count("*").alias("total_labeled_rows")]
    columns += [F.count_if(here(p)).alias(f"{p}_rows") for p in ("train", "calibration", "test")]
    if group:
        for p in ("calibration", "test"):
            columns.append(F.count_distinct(F.when(here(p), F.col(group))).alias(f"{p}_groups"))
    if at:
        columns += [
            F.max(F.when(here("train"), F.col(at))).alias("train_max_at"),
            F.max(F.when(here("calibration"), F.col(at))).alias("calibration_max_at"),
            F.min(F.when(here("test"), F.col(at))).alias("test_min_at"),
        ]
    out = df.groupBy(*by).agg(*columns)
    short = F.col("test_rows") < F.lit(min_test_rows if min_test_rows is not None else 0)
    return out.withColumn("status", F.when(short, "INSUFFICIENT_SAMPLE").otherwise("OK"))


def split_groups(df: DataFrame, group: str) -> DataFrame:
    """The groups of each part, one row each."""
    return df.where(F.col("split").isNotNull()).select("split", group).distinct()


def split_invariants(
    df: DataFrame, row_id: str, at: str | None = None, cutoff: Column | None = None, group: str | None = None
) -> DataFrame:
    """Counts of broken split rules, one row each: (invariant, n_bad)."""
    spread = df.groupBy(row_id).agg(F.count_distinct("split").alias("_k"))
    checks = [spread.agg(F.lit("ids_in_one_split").alias("invariant"), F.count_if(F.col("_k") > 1).alias("n_bad"))]
    if at is not None and cutoff is not None:
        held = F.col("split").isin("calibration", "test")
        checks.append(
            df.agg(
                F.lit("train_before_cutoff").alias("invariant"),
                F.count_if((F.col("split") == "train") & (F.col(at) >= cutoff)).alias("n_bad"),
            )
        )
        checks.append(
            df.agg(
                F.lit("holdout_after_cutoff").alias("invariant"),
                F.count_if(held & (F.col(at) < cutoff)).alias("n_bad"),
            )
        )
    if group:
        seen = df.groupBy(group).agg(
            F.bool_or(F.col("split") == "train").alias("_a"), F.bool_or(F.col("split") == "test").alias("_b")
        )
        checks.append(
            seen.agg(F.lit("groups_not_shared").alias("invariant"), F.count_if(F.col("_a") & F.col("_b")).alias("n_bad"))
        )
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def split_dataset(
    df: DataFrame, mode: str, row_id: str, label: str, labelled: Column | None = None, group: str = "ward",
    at: str = "inspected_at", cutoff: str | None = None, test_start: str | None = None, test_end: str | None = None,
    holdout: Sequence | None = None, seed: int = fv.SEED, min_test_rows: int | None = None, key: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Labelled rows with a `split` column, and the one-row metadata table. Broken invariants raise."""
    if mode not in MODES:
        raise ValueError(f"unknown split mode: {mode}")
    if mode in ("temporal", "spatial-temporal") and cutoff is None:
        raise ValueError(f"a cutoff is required for the {mode} split")
    labelled = F.col(label).isNotNull() if labelled is None else labelled
    rows = df.where(labelled)
    stamp = lambda text: None if text is None else F.lit(text).cast("timestamp_ntz")
    when = stamp(cutoff)
    if mode == "random":
        parted = random_split(rows, row_id, F.col(label) == fv.POSITIVE_LABEL, seed=seed, key=key)
    elif mode == "temporal":
        parted = temporal_split(rows, at, when, row_id, stamp(test_start), stamp(test_end))
    else:
        parts = listed_groups(rows, group, holdout) if holdout else holdout_groups(rows, group, seed, key)
        if mode == "geographic":
            parted = by_groups(rows, group, parts)
        else:
            parted = spatial_temporal_split(rows, group, at, when, parts)
    parted = stage(parted.where(F.col("split").isNotNull()))
    meta = split_metadata(
        parted, mode, at if at in df.columns else None, group if mode in ("geographic", "spatial-temporal") else None,
        min_test_rows,
    )
    first = meta.first()
    if first["total_labeled_rows"] == 0:
        raise ValueError("no labelled rows to split")
    if mode == "temporal" and first["calibration_rows"] + first["test_rows"] == 0:
        raise ValueError(f"no rows at or after {cutoff}")
    timed = mode in ("temporal", "spatial-temporal")
    broken = split_invariants(
        parted, row_id, at if timed else None, when, group if mode in ("geographic", "spatial-temporal") else None
    ).where("n_bad > 0").collect()
    if broken:
        raise ValueError(f"split leaks: {[r['invariant'] for r in broken]}")
    return parted, meta


def inner_validation(
    df: DataFrame, row_id: str, mode: str, group: str = "ward", seed: int = fv.SEED, key: Column | None = None
) -> DataFrame:
    """Mark early-stopping rows in `is_validation`: a tenth of the groups, or 15 % of the rows by hash."""
    if mode in ("geographic", "spatial-temporal"):
        key = unit_hash(F.col(group), seed) if key is None else key
        groups = df.select(group).distinct()
        ranked = hash_rank(groups, key, group, name="_rank")
        size = F.greatest(F.lit(1), F.floor(groups.agg(F.count("*")).scalar() / 10))
        chosen = ranked.where(F.col("_rank") <= size).select(group, F.lit(True).alias("_v"))
        return df.join(chosen, group, "left").withColumn("is_validation", F.coalesce("_v", F.lit(False))).drop("_v")
    key = unit_hash(F.col(row_id), seed) if key is None else key
    ranked = hash_rank(df, key, row_id, name="_rank")
    size = F.round(df.agg(F.count("*")).scalar() * PART_SHARE)
    return ranked.withColumn("is_validation", F.col("_rank") <= size).drop("_rank")
