"""Targets against the stated iteration, exact quotas, hypergeometric draws, and the mix against its plan."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.queries import QUERIES


def plain_targets(sizes, weights=(1, 2, 3), top=3):
    """sizes: {source or None: words}. Cap what is above its limit and share the rest again, until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s for s in names if s not in capped}
        left = total - sum(capped.values())
        target = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        above = {s: float(top * sizes[s]) for s in rest if target[s] > top * sizes[s]}
        if not above:
            return {**target, **capped}
        capped.update(above)


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 1, "c": 2, "d": 1000, "e": 3}, {"a": 10}, {"a": 0, "b": 5, "é": 7, None: 2}, {"a": 1, "b": 1, "c": 1}, {chr(97 + i): 7**i % 1000 for i in range(20)}, {"a": 0},
])
def test_targets(spark, sizes):
    rows = [("z" if s is None else f"s{s}", n) for s, n in sizes.items()]
    got = {r.key: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "key string, source_size long")).collect()}
    want = plain_targets(sizes)
    for s, t in want.items():
        assert math.isclose(got["z" if s is None else f"s{s}"], t, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("q, t, n", [(5, 20, 7), (40, 60, 31), (1, 2, 1), (9, 9, 4), (300, 1000, 500)])
def test_hypergeometric_quantiles(spark, q, t, n):
    """The drawn number is the distribution's quantile at u."""
    p = [math.comb(q, x) * math.comb(t - q, n - x) / math.comb(t, n) if 0 <= n - x <= t - q else 0.0 for x in range(min(q, n) + 1)]
    us = [(i + 0.5) / 200 for i in range(200)]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    got = [r.x for r in df.select("u", F.expr(mixing.hypergeometric(f"{q}L", f"{t}L", f"{n}L", "u")).alias("x")).orderBy("u").collect()]
    for u, x in zip(us, got):
        below, upto = sum(p[:x]), sum(p[: x + 1])
        assert below - 1e-4 <= u <= upto + 1e-4


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_quotas_add_up(spark, shards):
    quotas = {f"s{i}": (i * 37) % 90 for i in range(25)}
    df = spark.createDataFrame(list(quotas.items()), "key string, q long")
    got = mixing.split_quotas(df, shards).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        assert 0 <= r.shard < shards and r.q > 0
        by_source[r.key] += r.q
        by_shard[r.shard] += r.q
    assert by_source == Counter({k: v for k, v in quotas.items() if v})
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == shards


def test_query_comes_near_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {r.doc_id: len([w for w in __import__("re").split("[\x20\x09-\x0d]+", r.text or "") if w]) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    sizes = Counter()
    for k, n in size.items():
        sizes[source[k]] += n
    want = plain_targets(sizes)
    got = QUERIES["op5_source_mix"](spark, sf).collect()
    again = {r.doc_id: r.taken for r in QUERIES["op5_source_mix"](spark, sf).collect()}
    taken, longest = Counter(), Counter()
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and again[r.doc_id] == r.taken
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1


def odd(spark):
    rows = [(i, f"word {i} " * (i % 9 + 1), ["a", "b", None, "é"][i % 4], "x", 5) for i in range(200)]
    rows += [(None, None, "a", "x", 5)] * 3 + [(7, "said twice", "b", "x", 5)] * 4 + [(8, "", None, "x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, ident int")


def test_mix_holds_each_row_as_often_as_planned(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    docs = odd(spark)
    plan = mixing.plan_mix(docs, shards=4).collect()
    assert len(plan) == docs.count()
    want = defaultdict(int)
    for r in plan:
        assert len(r.shards) == r.copies and all(0 <= s < 4 for s in r.shards) and r.copies <= 3
        want[r.ident] += r.copies
    mix = mixing.mixed_rows(docs, shards=4)
    assert mix.dtypes == docs.dtypes
    got = Counter(r.h for r in mix.select(F.xxhash64(*docs.columns).alias("h")).collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    other = mixing.plan_mix(docs.repartition(7), shards=4).collect()  # neither order nor partitions matter
    assert Counter((r.doc_id, r.ident, tuple(r.shards)) for r in other) == Counter((r.doc_id, r.ident, tuple(r.shards)) for r in plan)


def test_shards_hold_random_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    per = Counter()
    for r in mixing.plan_mix(docs, shards=3, weights=(1,)).collect():
        for s in r.shards:
            per[s, r.doc_id % 3] += 1
    assert all(60 <= n <= 140 for n in per.values()) and len(per) == 9


def test_empty_table(spark):
    empty = odd(spark).limit(0)
    assert mixing.plan_mix(empty).collect() == [] and mixing.mixed_rows(empty).collect() == []
