"""Ranks, running sums and order statistics over a whole table, without a one-task global window.

One way at every size, for every order Spark can sort by (nulls and NaN included):

* `running_totals` - sums strictly before each row along an order column. Rows are first collapsed to one per order
  value by the caller, so ties (a hot value) never meet in one task. Rows are range partitioned, the totals of the
  partitions are prefix-summed and joined back, and windows run inside partitions.
* `global_rank` - 1..n over any composite order, by range partitioning and per-partition offsets.
* `hash_rank` - 1..n within strata by a uniform 32-bit key, bucketed by its top bits; needs no sampling.

Groups may be null: joins back are null-safe, so a null group is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.session import stage

HASH_BUCKET_BITS = 16
POSITION_BITS = 33


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key; the key columns of `left` stay."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def _in_ranges(rows: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """Adds `_range`, the number of the row's range partition along `order`, and writes the result."""
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return stage(ranged.withColumn("_range", F.spark_partition_id()))


def running_totals(
    rows: DataFrame,
    order: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add `<name>_before` for each of `totals`: its sum over rows strictly before along `order`.

    `order` is unique within `by`. Null comes first in ascending order and last in descending, NaN is above all
    numbers, as in any Spark sort. `partitions` sets the number of ranges (by default Spark's shuffle partitions).
    """
    direction = F.desc(order) if descending else F.asc(order)

    def before(window, name: str, source: str) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(source).over(frame), F.lit(0)).alias(name)

    ranged = _in_ranges(rows, [*[F.col(b) for b in by], direction], partitions)
    keys = [*by, "_range"]
    sums = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"_s_{c}") for c in totals])
    # one row per group and range from here: groups that lie inside one range have one
    across = Window.partitionBy(*by).orderBy("_range")
    offsets = sums.select(*keys, *[before(across, f"_o_{c}", f"_s_{c}") for c in totals])
    inside = Window.partitionBy(*keys).orderBy(direction)
    local = ranged.select("*", *[before(inside, f"_l_{c}", c) for c in totals])
    joined = null_safe_join(local, offsets, keys)
    return joined.select(
        *rows.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{c}_before") for c in totals]
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Dense position 1..n by `order` (end it with a unique key for a deterministic result)."""
    ranged = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", POSITION_BITS))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per range partition, so this window and the broadcast are bounded by the partition count
    window = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(window), F.lit(0)).alias("_skip"))
    position = F.col("_pos").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return ranged.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_skip") + position + 1).alias(name)
    )


def hash_rank(df: DataFrame, key: Column, tie: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Dense position 1..n within `by`, ordered by (`key`, `tie`); `key` lies uniformly in [0, 2^32)."""
    keyed = df.withColumn("_key", key)
    keyed = keyed.withColumn("_bucket", F.shiftright("_key", 32 - HASH_BUCKET_BITS))
    groups = [*by, "_bucket"]
    sizes = keyed.groupBy(*groups).agg(F.count("*").alias("_n"))
    across = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy(*groups).orderBy("_key", tie)
    ranked = keyed.withColumn("_pos", F.row_number().over(inside))
    joined = null_safe_join(ranked, offsets, groups)
    return joined.select(*df.columns, (F.col("_skip") + F.col("_pos")).alias(name))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key by `order`.

    Spark limits each key to one row per task before the shuffle, so a key that holds a third of the rows costs one
    row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First `k` rows by `order` with their rank; `k` is a report size, the result is k rows."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def quantile(
    df: DataFrame, value: str, level: Column | Sequence[Column], by: Sequence[str] = (), name: str = "quantile",
    partitions: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantile at data-dependent levels: one row (by..., n_rows, name).

    A level may use the column `n_rows`; for several levels `name` is an array in their order. Exact: reads
    the values at positions floor(h) and ceil(h) with h = level * (n_rows - 1). Null values do not count, NaN is above
    all numbers. Rows are collapsed to one per distinct value, and only the ranges that hold a wanted position are
    ordered.
    """
    levels = [level] if isinstance(level, Column) else list(level)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    keyed = _in_ranges(counts, [*[F.col(b) for b in by], F.asc(value)], partitions)
    keys = [*by, "_range"]
    sizes = keyed.groupBy(*keys).agg(F.sum("n").alias("_size"))
    # one row per group and range from here on
    mine = Window.partitionBy(*by)
    earlier = F.sum("_size").over(mine.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    at = sizes.select(*keys, "_size", F.coalesce(earlier, F.lit(0)).alias("_skip"), F.sum("_size").over(mine).alias("n_rows"))
    position = lambda q: (q.cast("double") * (F.col("n_rows") - 1)).alias("_h")
    asked = F.array(*[F.struct(F.lit(i).alias("_i"), position(q)) for i, q in enumerate(levels)])
    at = at.select("*", F.inline(asked)).withColumns({"_lo": F.floor("_h"), "_hi": F.ceil("_h")})
    wanted = lambda p: (F.col("_skip") <= F.col(p)) & (F.col(p) < F.col("_skip") + F.col("_size"))
    rows = null_safe_join(keyed, at.where(wanted("_lo") | wanted("_hi")), keys)
    end = F.col("_skip") + F.sum("n").over(Window.partitionBy(*keys, "_i").orderBy(value))
    rows = rows.withColumn("_end", end)
    holds = lambda p: (F.col("_end") - F.col("n") <= F.col(p)) & (F.col(p) < F.col("_end"))
    picked = rows.groupBy(*by, "n_rows", "_i", "_h", "_lo").agg(
        F.max(F.when(holds("_lo"), F.col(value))).alias("_v0"), F.max(F.when(holds("_hi"), F.col(value))).alias("_v1")
    )
    # no interpolation at a whole position: infinity minus infinity would make it NaN
    exact = F.when(F.col("_h") == F.col("_lo"), F.col("_v0")).otherwise(
        F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_h") - F.col("_lo"))
    )
    picked = picked.select(*by, "n_rows", "_i", exact.alias(name))
    if isinstance(level, Column):
        return picked.drop("_i")
    values = F.transform(F.sort_array(F.collect_list(F.struct("_i", name))), lambda e: e[name])
    return picked.groupBy(*by, "n_rows").agg(values.alias(name))
