"""Joins against groups of very uneven size, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.tables import written

HOT_SHARE = 2000
TASK_EDGES = 50_000


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int | None = None) -> DataFrame:
    """Inner join of `rows` with one row per group (a written table); `size` is a group's number of rows, `total` their sum.

    The fewer than `HOT_SHARE` groups with more than 1/`HOT_SHARE` of all rows are broadcast, the others are shuffled,
    so that no key brings many rows into one task. Without such groups it is one join.
    """
    most, all_rows = groups.agg(F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    total = all_rows if total is None else total
    if most * HOT_SHARE <= total:  # `rows` are read once, and the driver has nothing to broadcast
        return rows.join(groups, keys)
    hot = F.col(size) * HOT_SHARE > total
    large, small = F.broadcast(groups.where(hot)), groups.where(~hot)
    rest = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(large, keys).unionByName(rest.join(small, keys))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows (a, b) of longs to (node, component): the smallest node reachable, for every node that has an edge.

    Large-star and small-star steps in turn: each round every node hands its neighbours to the smallest among them, so
    a component becomes a star after a number of rounds that is logarithmic in practice. Each step works on a written
    table of at most as many edges as there were; hot centres are split by `attach`.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    state, before = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), None
    for _ in range(rounds):
        if state == before or not state[0]:
            break
        tasks = -(-2 * state[0] // TASK_EDGES)  # no more tasks and files than the edges left are worth
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = attach(both, written(least.coalesce(tasks), "least"), ["u"], "n", 2 * state[0])
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        state, before = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), state
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
