"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Sizes per source, targets by weight (water filling under the repeat limit).
2. A source's rows are dealt by hash into blocks of about `BLOCK_ROWS` rows; blocks in hash order are a random
   permutation. A target of q whole passes plus a rest takes every block q times and a prefix of the permuted blocks
   once more; in the block where the rest ends, rows in hash order up to the cut nearest to it.
3. The drawn blocks of all sources are exact integer quotas. A binary tree over the output shards splits them: a node
   hands its left half a number of blocks per source drawn from the multivariate hypergeometric distribution, and the
   rest goes right. So every shard's mix is a random draw, and all quotas add up exactly.
4. A source's permuted blocks fill the shards' quotas in order, which makes the draws disjoint; within a shard, rows
   are ordered by hash.

Only one number per source passes through the tree, and one row per source and block through the joins. Texts are
not touched until the mix itself is made, and then move to their plan row and to their shard. The number of sources
is taken to be far smaller than that of rows; where it is not small enough to broadcast, joins shuffle instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.tables import free, text_or_empty, written

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SHARDS = 64
BLOCK_ROWS = 256
SEED = 7
BROADCAST_SOURCES = 20_000


def word_count(column: str) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.regexp_count(text_or_empty(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds `target` to rows of (key, source_size), one per source; keys in order take `weights` in turn.

    All words are shared in proportion to the weights, a target stops at `max_repeat` times its source, and what it
    leaves is shared again by weight. That is water filling: with sources sorted by limit / weight there is one level
    such that exactly the sources before some position are at their limit and the others at level times weight.
    """
    position = F.row_number().over(Window.orderBy("key")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (position % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("top", F.col("source_size") * F.lit(float(max_repeat)))
    by_limit = Window.orderBy(F.col("top") / F.col("w"), "key")
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum("top").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("w").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    # the level if exactly the sources before this one are at their limit; it holds if this one stays below its own, and
    # capping a source that is below its limit only lowers it, so the right one is the largest that holds
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) - capped) / weight_left)
    holds = F.when(F.col("level") * F.col("w") <= F.col("top"), F.col("level"))
    rows = rows.withColumn("level", F.max(holds).over(whole))
    target = F.coalesce(F.least("top", F.col("level") * F.col("w")), F.col("top"))
    return rows.select(*sizes.columns, target.alias("target"))


_LOG_FACTORIAL = """(CASE WHEN {n} < 2 THEN 0D ELSE ({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046727D
  + 1D / (12D * {n}) - 1D / (360D * pow({n}, 3)) + 1D / (1260D * pow({n}, 5)) END)"""


def _log_choose(n: str, k: str) -> str:
    f = [_LOG_FACTORIAL.format(n=f"CAST(({x}) AS DOUBLE)") for x in (n, k, f"{n} - ({k})")]
    return f"({f[0]} - {f[1]} - {f[2]})"


def hypergeometric(q: str, t: str, n: str, u: str) -> str:
    """SQL for how many of `q` marked among `t` blocks fall into a random `n`, by inverting the uniform `u`.

    Values more than ten standard deviations from the mean are left out; their probability is below 1e-20.
    """
    mean = f"(CAST({n} AS DOUBLE) * {q} / {t})"
    sd = f"sqrt({mean} * ({t} - {q}) / {t} * ({t} - {n}) / greatest({t} - 1, 1))"
    low = f"greatest(0L, {n} + {q} - {t}, CAST(floor({mean} - 10 * {sd} - 2) AS BIGINT))"
    high = f"least({q}, {n}, CAST(ceil({mean} + 10 * {sd} + 2) AS BIGINT))"
    log_p = f"{_log_choose(q, 'x')} + {_log_choose(f'({t} - {q})', f'{n} - x')} - {_log_choose(t, n)}"
    masses = f"transform(sequence({low}, {high}), x -> named_struct('x', x, 'p', exp({log_p})))"
    scan = f"""aggregate(ms, named_struct('left', {u} * aggregate(ms, 0D, (s, m) -> s + m.p), 'x', ms[0].x),
      (s, m) -> named_struct('left', s.left - m.p, 'x', if(s.left > 0, m.x, s.x)), s -> s.x)"""
    return f"CASE WHEN {q} = 0 OR {n} = 0 THEN 0L WHEN {n} = {t} THEN {q} ELSE transform(array({masses}), ms -> {scan})[0] END"


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Exact quotas (key, q) to (key, shard, q): every source's shares add up to its quota, and shards get equal
    numbers of blocks up to one. A shard without blocks of a source has no row for it.

    A node of the tree is one row: its shards [first, last) and the quotas of all sources as an array. Its left half
    gets its share of the blocks, drawn source by source from what is left of both.
    """
    total = "aggregate(qs, 0L, (s, e) -> s + e.q)"
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("key", F.col("q").cast("long").alias("q")))).alias("qs"))
    nodes = nodes.select("qs", F.lit(0).alias("first"), F.lit(shards).alias("last"), F.expr(total).alias("all"))
    edge = f"CAST(floor(CAST(all AS DECIMAL(30,0)) * {{}} / {shards}) AS BIGINT)"
    u = f"(shiftrightunsigned(xxhash64({seed}L, first, last, e.key), 11) + 0.5D) / 9007199254740992D"
    step = f"""named_struct('t', a.t - e.q, 'n', a.n - {{x}}, 'xs', concat(a.xs, array(named_struct('key', e.key, 'q', {{x}}))))"""
    draw = f"transform(array({hypergeometric('e.q', 'a.t', 'a.n', u)}), x -> {step.format(x='x')})[0]"
    zero = "named_struct('t', {t}, 'n', {n}, 'xs', CAST(array() AS ARRAY<STRUCT<key: STRING, q: BIGINT>>))"
    width = shards
    while width > 1:
        nodes = nodes.withColumn("cut", F.expr("if(last - first > 1, CAST(ceil((first + last) / 2) AS INT), last)"))
        start = zero.format(t=total, n=f"{edge.format('cut')} - {edge.format('first')}")
        nodes = nodes.withColumn("left", F.expr(f"aggregate(qs, {start}, (a, e) -> {draw}, a -> a.xs)"))
        right = F.zip_with("qs", "left", lambda p, x: F.struct(p["key"].alias("key"), (p["q"] - x["q"]).alias("q")))
        halves = F.array(
            F.struct(F.col("left").alias("qs"), "first", F.col("cut").alias("last")),
            F.struct(right.alias("qs"), F.col("cut").alias("first"), "last"),
        )
        nodes = nodes.select("all", F.explode(halves).alias("half")).select("half.*", "all").where("first < last")
        nodes = written(nodes, "tree")
        width = -(-width // 2)
    shares = nodes.select(F.col("first").alias("shard"), F.explode("qs").alias("e"))
    return shares.select("e.key", "shard", "e.q").where("q > 0")


def plan_mix(
    docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, ident (hash of the whole row), size, source_size, target, copies, shards (the
    output shard of every copy).

    A row is never taken more than `max_repeat` times. Null text has size 0. A null source is a source of its own,
    last. Repeated rows are rows of their own. Empty input gives an empty result. The plan depends on the rows' content
    and the seed alone, not on their order or partitions.
    """
    whole_row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("z"))  # "z" after all "s..."
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), whole_row.alias("ident"), key.alias("key"), word_count(text).alias("size")
    )
    rows = written(rows, "sizes")
    sources = written(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    targets = source_targets(sources, weights, max_repeat)
    passes = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")
    targets = targets.withColumns({"passes": passes, "blocks": F.ceil(F.col("rows") / BLOCK_ROWS).cast("long")})
    targets = written(targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    few = targets.count() <= BROADCAST_SOURCES

    def with_source(df: DataFrame, per_source: DataFrame) -> DataFrame:
        return df.join(F.broadcast(per_source) if few else per_source, "key")

    dealt = with_source(rows, targets.select("key", "source_size", "target", "blocks"))
    dealt = dealt.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "ident")).withColumn("block", F.pmod("h", "blocks")).drop("blocks")

    blocks = dealt.groupBy("key", "block").agg(F.sum("size").alias("block_size"))
    blocks = with_source(blocks, targets.select("key", "passes", "rest"))
    permuted = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "block"), "block")
    room = F.col("rest") - F.sum("block_size").over(permuted) + F.col("block_size")
    blocks = written(blocks.select("key", "block", "passes", room.alias("room")), "blocks")

    # a token is one pass over a block; the last pass may take a part of the block's rows only
    last = F.col("passes") - F.when(F.col("room") > 0, 0).otherwise(1)
    tokens = blocks.select("key", "block", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))).alias("pass"))
    tokens = written(tokens, "tokens")
    shares = split_quotas(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("q")), shards, seed)
    shares = shares.withColumn("end", F.sum("q").over(Window.partitionBy("key").orderBy("shard")))
    ends = written(shares.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends")), "ends")
    place = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block", "pass"), "block", "pass")
    tokens = with_source(tokens.withColumn("place", F.row_number().over(place)), ends)
    shard = F.filter("ends", lambda e: e["end"] >= F.col("place"))[0]["shard"]
    drawn = tokens.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", shard.alias("shard")))).alias("drawn"))
    drawn = drawn.select("key", "block", F.transform("drawn", lambda t: t["shard"]).alias("drawn"))
    blocks = written(blocks.join(drawn, ["key", "block"], "left"), "drawn")

    out = dealt.join(blocks, ["key", "block"])
    before = F.sum("size").over(Window.partitionBy("key", "block").orderBy("h", "ident")) - F.col("size")
    extra = (F.col("room") > 0) & (before + F.col("size") / 2 <= F.col("room"))
    out = out.withColumn("copies", (F.col("passes") + extra.cast("int")).cast("int"))
    taken = F.coalesce(F.slice("drawn", F.lit(1), F.col("copies")), F.array().cast("array<int>"))
    return out.select("doc_id", "ident", "size", "source_size", "target", "copies", taken.alias("shards"))


def mixed_rows(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: `docs` with each row as often as it is taken, the rows of a shard together and locally shuffled.

    Rows find their plan by doc_id and a hash of the whole row. Rows equal in all columns share one place in the plan,
    which holds all their copies. Columns are those of `docs`.
    """
    seed = options.get("seed", SEED)
    ident, shards, many, plan_id, plan_ident = (free(docs, c) for c in ("ident", "shards", "many", "plan_id", "plan_ident"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    plan = plan_mix(docs, source, text, doc_id, **options).groupBy("doc_id", "ident").agg(
        F.flatten(F.collect_list("shards")).alias(shards), (F.count(F.lit(1)) > 1).alias(many)
    )
    plan = plan.where(F.size(shards) > 0).select(F.col("doc_id").alias(plan_id), F.col("ident").alias(plan_ident), shards, many)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(plan_id)) & (F.col(ident) == F.col(plan_ident))
    found = docs.withColumn(ident, F.xxhash64(*names)).join(plan, same).drop(plan_id, plan_ident)
    once = found.where(~F.col(many)).unionByName(found.where(many).dropDuplicates([doc_id, ident]))
    out = once.select(*names, ident, F.posexplode(shards).alias(many, shards))
    # partitions follow the shards; the order within is random and repeatable
    order = F.xxhash64(F.lit(seed), ident, many)
    return out.repartition(F.col(shards)).sortWithinPartitions(F.col(shards), order).select(*names)
