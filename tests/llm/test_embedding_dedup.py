"""Range search in pruned graphs against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from plumbline.llm import embedding_dedup as ed, groups
from plumbline.llm.queries import QUERIES


def brute(rows, threshold=0.98):
    """(number of links, component) per row; rows are (vec_id, embedding, label)."""
    ok = [e is not None and len(e) > 0 and label is not None and all(v is not None and math.isfinite(v) for v in e) and any(e) for _, e, label in rows]
    unit = [np.array(e, "f4").astype(float) / np.linalg.norm(np.array(e, "f4").astype(float)) if o else None for o, (_, e, _) in zip(ok, rows)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    best = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            best[root(i)] = min(k, best.get(root(i), k))
    return [(k, n, best.get(root(i))) for i, ((k, _, _), n) in enumerate(zip(rows, links))]


def key(r):
    return tuple((v is None, v or 0) for v in r)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op8_graph_dedup"](spark, sf).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1),
        (8, [float("inf"), 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (12, [-1.0, 0.0], 1),
        (None, [0.0, 1.0], 3), (13, [1e-30, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, kept string, node int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in ed.near_groups(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert ed.near_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("part", [64, 4096])
def test_a_hot_group_split_into_parts(spark, monkeypatch, part):
    monkeypatch.setattr(ed, "PART", part)
    monkeypatch.setattr(ed, "CLUSTER_NODES", 100)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    dense = centre + rng.normal(size=(250, 16)) * 0.1
    loose = rng.normal(size=(150, 16))
    x = np.concatenate([dense, loose, loose[:40] + rng.normal(size=(40, 16)) * 0.05, np.repeat(dense[:1], 30, axis=0)]).astype("f4")
    rows = [(i, [float(a) for a in v], i % 2 if 250 <= i < 300 else 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_groups(df).collect()}
    want = {k: (n, c) for k, n, c in brute(rows)}
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


@pytest.mark.parametrize("spread", [0.1, 0.2])
def test_more_near_copies_than_a_few_shards_hold(spark, monkeypatch, spread):
    """All pairs in range (one centre is left), and about half of them (many centres are)."""
    monkeypatch.setattr(ed, "CLUSTER_NODES", 64)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=64)
    centre *= np.sqrt(2) * 0.7 / np.linalg.norm(centre)
    x = (centre + rng.normal(size=(1600, 64)) * spread * 0.7 / 8).astype("f4")
    unit = ed.unit_rows(x.astype(float))
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in ed.near_groups(df).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert want.sum() > 100_000 and (links <= want).all() and links.sum() >= 0.98 * want.sum()
    assert all(r.audited_recall >= 0.98 for r in got.values())


def test_a_label_that_fails_its_audit_is_searched_whole(spark, monkeypatch):
    """The first search is asked about some shards only; what it misses is found by the second."""
    monkeypatch.setattr(ed, "CLUSTER_NODES", 64)
    first, visits = [], ed._visits

    def some(homes, centres, radii, margins, threshold):
        if first:
            return visits(homes, centres, radii, margins, threshold)
        first.append(1)
        return homes.drop("cos").where("shard > 0").select("label", "dim", "node", "weight", "vec", "shard")

    monkeypatch.setattr(ed, "_visits", some)
    rng = np.random.default_rng(3)
    x = rng.normal(size=64) + rng.normal(size=(800, 64)) * 0.16
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)] + [(1000 + i, [float(i), 1.0], 5) for i in range(20)]
    got = ed.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    unit = ed.unit_rows(x)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in got if r.vec_id < 1000} == dict(enumerate(want.tolist()))
    assert all(r.audited_recall >= 0.95 for r in got if r.vec_id < 1000)


def test_lengths_do_not_matter(spark):
    """Components that single precision, or squares in double precision, cannot hold; digits that only a double has."""
    near = math.acos(0.98)
    rows = [(f * 10 + i, [s * math.cos(a), s * math.sin(a)], f) for f, s in enumerate([1.0, 1e-30, 1e30, 1e-200, 1e200]) for i, a in enumerate([0.0, near - 1e-10, near + 1e-10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in ed.near_groups(df).collect()} == {f * 10 + i: [1, 2, 1][i] for f in range(5) for i in range(3)}
    narrow = [(i, [1e-30 * v, 1e-30], 0) for i, v in enumerate([1.0, 1.01, -1.0])] + [(i, [1e30 * v, 1e30], 0) for i, v in ((3, 1.0), (4, -1.0))]
    df = spark.createDataFrame(narrow, "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: r.n_links for r in ed.near_groups(df).collect()} == {0: 2, 1: 2, 2: 1, 3: 2, 4: 1}


def test_pruned_lists_are_not_dominated():
    rng = np.random.default_rng(0)
    x = ed.unit_rows(rng.normal(size=(300, 8))).astype("f4")
    graph = ed.build_graph(x)
    for i in range(0, 300, 7):
        kept = graph[i][graph[i] >= 0]
        assert i not in kept and len(set(kept)) == len(kept)
        d = np.linalg.norm(x[kept] - x[i], axis=1)
        assert (np.diff(d) >= -1e-3).all()
        for a in range(len(kept)):
            for b in range(a):
                assert ed.ALPHA * np.linalg.norm(x[kept[b]] - x[kept[a]]) > d[a] - 1e-3


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000), (4000, 4500), (4500, 5000), (7, 7), (7, 8)]
    got = {r.node: r.component for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {4000: 4000, 4500: 4000, 5000: 4000}
    assert got == want
    assert groups.components(spark.createDataFrame([], "a long, b long")).collect() == []
