"""The Jaccard join against brute force over shingle sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import jaccard_join as jj
from plumbline.llm.groups import attach
from plumbline.llm.queries import QUERIES


def shingle_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """[(doc_id, n_shingles, component_id)] of rows (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for pair in {(j, i) for ids in where.values() for k, i in enumerate(ids) for j in ids[:k]}:
        a, b = (sets[i] for i in pair)
        both = len(a & b)
        if 100 * both >= 80 * (len(a) + len(b) - both):
            parent[root(pair[0])] = root(pair[1])
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[root(i)] = min(k, best.get(root(i), k))
    return [(k, len(s), best.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple((v is None, v or 0) for v in r)


def same(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, sig int, component string")
    got = [tuple(r) for r in jj.near_duplicates(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_query_against_brute_force(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op7_jaccard_join"](spark, sf).collect())
    assert got == sorted(brute(rows)) and any(r[0] != r[2] for r in got)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [8, 4096])
def test_families_near_the_threshold(spark, monkeypatch, tile):
    """Chains of near copies whose similarity lies around 0.8, a passage that many share, and small parts of cells."""
    monkeypatch.setattr(jj, "TILE", tile)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    for length, n, edits in ((60, 60, 3), (120, 40, 6), (25, 30, 1), (300, 10, 14), (8, 20, 1)):
        texts += family(rng, [word() for _ in range(length)], n, edits)
    passage = [word() for _ in range(40)]
    texts += [" ".join([word() for _ in range(rng.randint(0, 12))] + passage + [word() for _ in range(rng.randint(0, 12))]) for _ in range(80)]
    grow = [word() for _ in range(100)]
    texts += [" ".join(grow[: 40 + 2 * i]) for i in range(30)]
    same(spark, list(enumerate(texts)))


def test_odd_texts(spark):
    texts = [None, "", "  \t", "one", "One", "one two three four", "one two three  four\n", "a b c d e", "A b c d e", "a b c d e f", "é b c d e", "É b c d e", "x " * 3000, "x " * 4000, "one two"]
    rows = list(enumerate(texts)) + [(None, "one"), (None, "lonely words of no one else at all"), (None, "lonely words of no one else at all"), (3, "one"), (3, "other")]
    same(spark, rows)
    assert jj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_whose_polynomials_agree_are_told_apart(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [" ".join(f"{w}{k}{w}" for k in range(12)) for w in (one, other)]
    rows = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, one), (4, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jj.near_duplicates(rows).collect()) == [(i, i) for i in (1, 2, 3, 4)]


def test_keep_one_keeps_columns_with_internal_names(spark):
    names = ["_id", "_key", "text_key", "stays", "judged_id", "judged_key", "n_shingles", "component_id", "sig", "token", "n"]
    rows = [(i, "the same five words here" if i < 3 else f"another text number {i} altogether") for i in range(5)]
    docs = spark.createDataFrame([(*r, *(f"own {c}" for c in names)) for r in rows], ["doc_id", "text", *names])
    out = jj.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in docs.collect() if r.doc_id not in (1, 2))


def test_keep_one(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    near = [" ".join(base), " ".join(base + ["more"]), " ".join(["less"] + base)]
    rows = [(9, near[0]), (4, near[1]), (6, near[2]), (6, "quite another text under a used id"), (7, None), (7, None), (8, "said twice by a row of words"), (8, "said twice by a row of words"), (None, near[0]), (None, "nobody knows who wrote these words")]
    df = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, lang string, stays int")
    out = jj.keep_one(df)
    assert out.dtypes == df.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert got == [(4, near[1]), (6, rows[3][1]), (7, None), (7, None), (8, rows[6][1]), (None, rows[9][1])]


def test_tree_finds_all_that_the_bound_leaves():
    rng = np.random.default_rng(5)
    centres = rng.poisson(2, (12, jj.GROUPS))
    points = np.maximum(0, centres[rng.integers(0, 12, 700)] + rng.integers(-1, 2, (700, jj.GROUPS)) * (rng.random((700, jj.GROUPS)) < 0.15))
    sizes, comps = points.sum(axis=1), rng.integers(0, 300, 700)
    q, at, bound = jj.CountTree(points, sizes, comps).search(points, sizes, comps)
    got = set(zip(q.tolist(), at.tolist()))
    assert len(got) == len(q)
    for i in range(0, 700, 9):
        overlap = np.minimum(points[i], points).sum(axis=1)
        fits = (overlap >= jj.least_overlap(sizes[i], sizes)) & (100 * sizes >= 80 * sizes[i]) & (80 * sizes <= 100 * sizes[i]) & (comps != comps[i])
        assert {j for a, j in got if a == i} == set(np.flatnonzero(fits).tolist())


def test_cells_across_batches():
    rng = random.Random(1)
    rows = sorted((rng.randrange(30), rng.randrange(2), rng.randrange(6), 5, False) for _ in range(150))
    want = sorted({r[:2] + r[2:4] for r in rows if len({x[2] for x in rows if x[:2] == r[:2]}) > 1})
    table = pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("token", pa.int64()), ("salt", pa.int32()), ("sig", pa.int64()), ("n", pa.int32()), ("split", pa.bool_())))})
    for size in (1, 2, 7, 150):
        out = pa.Table.from_batches(list(jj._shared_cells(iter(table.to_batches(size)))))
        assert sorted(zip(*(out.column(c).to_pylist() for c in ("token", "sig", "n")))) == sorted((t, s, n) for t, _, s, n in want)


def test_parities_bound_the_overlap_and_tell_long_texts_apart():
    rng = np.random.default_rng(3)
    read = lambda hashes: np.frombuffer(jj._parity(hashes), "u1")
    for _ in range(300):
        n, m = (int(k) for k in rng.integers(1, 2000, 2))
        k = int(rng.integers(0, min(n, m) + 1))
        h = rng.integers(0, 2**64, n + m, dtype=np.uint64)
        x, y = h[:n], np.concatenate([h[:k], h[n : n + m - k]])
        first, second, most = jj._overlap_bound(read(x), read(y))
        assert sorted((first, second)) == sorted((n, m)) and most >= k
    x, y = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    vectors = (np.frombuffer(jj._vector(h), "u1").astype(int) for h in (x, y))
    assert np.minimum(*vectors).sum() > 0.8 * 5000 and jj._overlap_bound(read(x), read(y))[2] < jj.least_overlap(5000, 5000)


def test_only_texts_of_asked_classes_are_gone_through(spark):
    """The filter goes by the whole text, so others are left out before their words are read."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts + texts[:50]], "text string").select(F.xxhash64("text").alias("text_key"), "text")
    keys = np.array([r.text_key for r in docs.collect()]).view(np.uint64)
    rows = jj._signatures(docs.select(F.lit(1).cast("long").alias("doc_id"), "text_key", "text")).where("kind = 0")
    classes = rows.groupBy("sig", F.col("n").cast("int").alias("n")).agg(F.min("text_key").alias("text_key"))
    asked = spark.createDataFrame(classes.limit(40).collect(), classes.schema)
    wanted = {r.text_key for r in asked.collect()}
    held = jj._may_hold(jj._filter(asked), keys)
    assert wanted <= set(keys[held].view(np.int64).tolist()) and held.sum() <= 2 * len(wanted) + 5
    got = jj._derived(docs, asked, vectors=False).collect()
    assert sorted((r.sig, r.n) for r in got) == sorted((r.sig, r.n) for r in asked.collect())
    assert all(len(r.data) == 8 * r.n for r in got)


def test_sets_are_in_order_of_rank_and_hash():
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 60]))) for _ in range(200)]
    rank = np.array([rng.choice([0, 0, 0, 1, 5]) for _ in range(jj.BUCKETS)])
    for ranks in (None, rank):
        for a, b, starts, h, _ in jj._sets(pa.array(texts), jj.WordHasher(), ranks):
            for i in range(a, b):
                own = h[starts[i - a] : starts[i - a + 1]].tolist()
                assert len(own) == len(shingle_set(texts[i]))
                order = [(int(ranks[jj._bucket(np.uint64(x))]) if ranks is not None else 0, x) for x in own]
                assert order == sorted(set(order))


def test_without_a_large_group_attach_is_one_join(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    even = rows.withColumn("n", F.lit(1)).withColumn("x", F.col("k") * 2)
    joined = attach(rows, even, ["k"], "n")
    assert "Union" not in joined._jdf.queryExecution().toString()
    assert joined.count() == 4000 and joined.where("x <> 2 * k").count() == 0
    uneven = even.withColumn("n", F.when(F.col("k") == 7, 5000).otherwise(1))
    assert attach(rows, uneven, ["k"], "n").count() == 4000
