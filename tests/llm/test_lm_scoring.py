"""Cross-entropy difference against a plain count over dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import lm_scoring as lm
from plumbline.llm.batches import WordHasher

ROWS = [
    (1, "the cat sat on the mat", True), (2, "The dog sat on the log\nand the cat", True), (3, "buy now buy cheap now", False),
    (4, "buy cheap cats now on the mat", None), (5, None, True), (6, "", False), (7, "  \t ", False), (8, "é É ü", False),
    (3, "buy now buy cheap now", False), (None, "one", False), (9, "word " * 60_000, False),
]


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]


def plain_losses(rows, min_count):
    """(target, background) loss of every text, straight from the definition."""
    total, together = Counter(), Counter()
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    texts = [(words(t), bool(mark)) for t, mark in rows]
    for ws, _ in texts:
        total.update(ws)
        together.update(zip(ws, ws[1:]))
    for ws, mark in texts:
        for m in [1] + [0] * mark:
            uni[m].update(w if total[w] >= min_count else None for w in ws)
            bi[m].update(p for p in zip(ws, ws[1:]) if together[p] >= min_count)
    size = sum(n >= min_count for n in total.values())
    n = [sum(u.values()) for u in uni]
    scale = [1.0, n[0] / n[1] if n[0] else 1.0]
    begun = [Counter(), Counter()]
    for m in (0, 1):
        for (v, _), c in bi[m].items():
            begun[m][v] += c

    def loss(m, ws):
        out = 0.0
        for i, w in enumerate(ws):
            name = w if total[w] >= min_count else None
            p = (scale[m] * uni[m][name] + lm.WORD_WEIGHT) / (scale[m] * n[m] + lm.WORD_WEIGHT * (size + 1))
            if i:
                v = ws[i - 1]
                p = (scale[m] * bi[m][v, w] + lm.HISTORY_WEIGHT * p) / (scale[m] * begun[m][v] + lm.HISTORY_WEIGHT)
            out -= math.log(p)
        return out / len(ws) if ws else None

    return [(loss(0, ws), loss(1, ws)) for ws, _ in texts]


def close(got, want):
    return got is want is None or abs(got - want) < 4 / lm.UNIT


@pytest.mark.parametrize("min_count", [1, 2, 3])
@pytest.mark.parametrize("hot, bits", [(0, 7), (8, 20), (1 << 20, 27)])
def test_scores_equal_plain_counts(spark, min_count, hot, bits):
    rows = [(a, b, c, 5.0, "x", -1) for a, b, c in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target boolean, score double, n_words string, row int")
    models = lm.fit(docs, min_count=min_count, hot=hot, filter_bits=bits)
    assert len(models.keys) <= hot
    got = lm.score(docs, models)
    assert got.columns == ["doc_id", "target", "row", "n_words", "loss_target", "loss_background", "score"]
    key = lambda i, n, t: (i is not None, i or 0, n, t)
    want = sorted((key(i, len(words(t)), m or False), x) for (i, t, m), x in zip(ROWS, plain_losses([r[1:] for r in ROWS], min_count)))
    got = sorted(got.collect(), key=lambda r: key(r.doc_id, r.n_words, r.target or False))
    assert len(got) == len(want)
    for r, (k, (t, b)) in zip(got, want):
        assert key(r.doc_id, r.n_words, r.target or False) == k and r.row == -1
        assert close(r.loss_target, t) and close(r.loss_background, b)
        assert r.score is None if t is None else abs(r.score - (t - b)) < 8 / lm.UNIT
    by_id = {r.doc_id: r for r in got}
    assert min_count > 2 or by_id[1].score < 0 < by_id[3].score


def test_packed_cells_come_back():
    rng = np.random.default_rng(5)
    for top in (3, 1 << 12, 1 << lm.CELL_BITS):
        cells = np.unique(rng.integers(0, top, 500).astype(np.uint64))
        counts = rng.integers(1, 400, len(cells))
        back, n = lm._unpacked(len(cells), lm._packed(cells, counts))
        assert (back == cells).all() and (n == np.minimum(counts, 255)).all()


def test_no_frequent_bigram_is_filtered_out(spark, monkeypatch):
    """Over many buckets and hand-overs, with counts above what a byte holds."""
    monkeypatch.setattr(lm, "HELD_PAIRS", 50)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 64)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 12, rng.integers(0, 40))) for _ in range(200)] + ["a b " * 800]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    pairs = Counter(p for t in texts for p in zip(words(t), words(t)[1:]))
    hasher = WordHasher()
    for least in (2, 30, 300, 700):
        bits = lm.frequent_cells(docs, "text", least, 16)
        found = Counter()
        for (v, w), n in pairs.items():
            data = f"{v} {w}".encode()
            h, _ = hasher(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            place = lm._cells(lm._pair_key(h[:1], h[1:])) >> np.uint64(lm.CELL_BITS - 16)
            found[n >= least, bool(lm._is_set(bits, place)[0])] += 1
        assert found[True, True] and not found[True, False] and found[False, True] <= 3


def test_models_of_one_table_score_another(spark):
    docs = spark.createDataFrame([("a b a b a b", True), ("c d c d c d", False)], "text string, target boolean")
    models = lm.fit(docs, min_count=1)
    other = spark.createDataFrame([("a b",), ("c d",), ("never seen",)], "text string")
    assert [r.score < 0 for r in lm.score(other, models).orderBy("score").collect()][0]
    assert lm.score(other, models).where("loss_target is null").count() == 0


def test_empty_and_unmarked_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, target boolean")
    models = lm.fit(docs)
    assert lm.score(docs, models).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    assert {r.doc_id: r.target for r in lm.marked(docs, ids).collect()} == {1: True, None: False}
    none = lm.marked(docs, ids.limit(0))
    assert all(r.score is None or math.isfinite(r.score) for r in lm.score(none, lm.fit(none, min_count=1)).collect())
    assert all(r.score is None or math.isfinite(r.score) for r in lm.score(docs, models).collect())


def test_query_equals_plain_counts(spark, sf):
    from plumbline.llm.queries import QUERIES

    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([i for i, _ in docs], plain_losses([(t, i in good) for i, t in docs], lm.MIN_COUNT)))
    got = QUERIES["op9_lm_scoring"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert all(close(r.loss_target, want[r.doc_id][0]) and close(r.loss_background, want[r.doc_id][1]) for r in got)


def test_word_hashes_do_not_depend_on_their_place():
    hasher = WordHasher()
    texts = ["a b  a", "", "b\x0ba\tccc", "a", "b" * 3000, "ça A"]
    data = [t.encode() for t in texts]
    edges = np.cumsum([0, *map(len, data)])
    hashes, first = hasher(np.frombuffer(b"".join(data), np.uint8), edges)
    assert np.diff(first).tolist() == [3, 0, 3, 1, 1, 2]
    by = dict(zip([w for t in texts for w in words(t)], hashes))
    assert [by[w] for t in texts for w in words(t)] == hashes.tolist() and len(set(by.values())) == len(by)


def test_query_tells_target_like_documents(spark, sf):
    from plumbline.llm.queries import QUERIES

    out = QUERIES["op9_lm_scoring"](spark, sf)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    assert out.count() == docs.count()
    mean = {r.quality: r.m for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert mean[1] < mean[0]


def test_planes_come_back_and_take_less_than_the_keys():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5000):
        keys = np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        columns = [rng.integers(-(1 << 50), 1 << 50, n), rng.integers(0, 3, n)]
        back = lm._from_planes(n, lm._planes(keys, columns), 2)
        assert all((a == b).all() for a, b in zip(back, [keys, *columns]))
    keys, rows = rng.integers(0, 1 << 64, 1 << 18, dtype=np.uint64), rng.integers(0, 2000, 1 << 18)
    _, sizes, data = lm._by_bucket(keys, [rows], 5)
    assert sum(sizes) == len(keys) and sum(map(len, data)) < 8.5 * len(keys)  # a key and a row number are 16 bytes


def test_lookups_in_many_blocks_and_buckets_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD_KEYS", 40)
    monkeypatch.setattr(lm, "LOOKUP_BYTES", 256)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 15, rng.integers(0, 30))), i % 3 == 0) for i in range(150)]
    docs = spark.createDataFrame([*rows, (-1, "w1 w2 " * 900, None)], "doc_id long, text string, target boolean").repartition(4)
    want = {r.doc_id: r for r in lm.score(docs, lm.fit(docs)).collect()}
    models = lm.fit(docs, hot=3, filter_bits=9)
    assert models.cold.count() > 100
    got = lm.score(docs, models).collect()
    assert len(got) == len(want) == 151
    assert all(r[1:] == want[r.doc_id][1:] for r in got)


def test_numbers_come_back_from_keys_and_other_words_get_odd_ones():
    rng = np.random.default_rng(9)
    v, w = rng.integers(0, lm.CODES + 1, (2, 4000)).astype(np.uint64)
    keys = lm._keys(v, w)
    assert not (keys & np.uint64(1)).any() and len(np.unique(keys)) == len(set(zip(v.tolist(), w.tolist())))
    assert all((a == b).all() for a, b in zip(lm._numbers(keys), (v, w)))
    assert np.bincount((keys >> np.uint64(61)).astype(int), minlength=8).min() > 400
    codes = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64) << np.uint64(1))
    names = lm._named(np.r_[codes, codes + np.uint64(2)], codes)
    assert names[:50].tolist() == list(range(1, 51)) and (names[50:] > lm.CODES).all()
    keys = lm._keys(np.r_[names[50:], names[:50], names[50:]], np.r_[names[:50], names[50:], names[50:]])
    assert (keys & np.uint64(1)).all() and len(np.unique(keys)) == 150


def test_counted_bigrams_take_few_bytes():
    """18 bytes a row when bigrams went to the shuffle one by one."""
    rng = np.random.default_rng(10)
    v, w = (rng.zipf(1.3, 1 << 20) % 200_000 + 1 for _ in "vw")
    keys, n, t = lm._added_up(lm._keys(v.astype(np.uint64), w.astype(np.uint64)) | rng.integers(0, 2, 1 << 20).astype(np.uint64))
    assert n.sum() == 1 << 20 and (t <= n).all() and not (keys & np.uint64(1)).any()
    _, sizes, data = lm._in_buckets(keys, [n, t], 6)
    assert sum(sizes) == len(keys) > 200_000 and sum(map(len, data)) < 5 * len(keys)


@pytest.mark.parametrize("codes", [0, 6, lm.CODES])
def test_counts_over_many_hand_overs_are_exact(spark, monkeypatch, codes):
    for name, value in (("HELD_COUNTS", 50), ("COUNT_BYTES", 512), ("HELD_PAIRS", 50), ("HELD_WORDS", 50), ("HELD_KEYS", 50)):
        monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(11)
    rows = [(" ".join(f"w{i}" for i in rng.integers(0, 14, rng.integers(0, 40))), i % 3 == 0) for i in range(200)] + [("a B " * 800, True), (None, True)]
    docs = spark.createDataFrame(rows, "text string, target boolean").repartition(5)
    single, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for t, mark in rows:
        for m in [0] + [1] * mark:
            single[m].update(words(t))
            pairs[m].update(zip(words(t), words(t)[1:]))
    found = lm.word_counts(docs, "text", "target", 285, 3).collect()
    often = sorted((n, single[1][w]) for w, n in single[0].items() if n >= 285)
    assert sorted((r.n, r.t) for r in found if r.w is not None) == often and 2 < len(often) < len(single[0])
    assert sum(r.n for r in found) == sum(single[0].values()) and sum(r.t for r in found) == sum(single[1].values())
    known = np.sort(np.array([r.w for r in lm.word_counts(docs, "text", "target", 1, 3).collect() if r.w is not None]).view(np.uint64))
    assert len(known) == len(single[0])
    for least in (1, 12, 700):
        got = lm.pair_counts(docs, "text", "target", least, 16, 3, known[:codes], codes >= len(known)).collect()
        assert sorted((r.n, r.t) for r in got) == sorted((n, pairs[1][p]) for p, n in pairs[0].items() if n >= least)
        assert len({(r.v, r.w) for r in got}) == len(got)


def test_scores_do_not_depend_on_which_words_have_numbers(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{j}" for j in rng.zipf(1.5, rng.integers(0, 60)) % 40), i % 3 == 0) for i in range(150)]
    docs = spark.createDataFrame([*rows, (-1, "w1 w2 " * 900, None), (-2, None, True)], "doc_id long, text string, target boolean").repartition(4)
    want = {r.doc_id: r for r in lm.score(docs, lm.fit(docs)).collect()}
    plain = plain_losses([r[1:] for r in rows] + [("w1 w2 " * 900, None)], lm.MIN_COUNT)
    assert all(close(want[i].loss_target, t) and close(want[i].loss_background, b) for i, (t, b) in zip([*range(150), -1], plain))
    for codes, hot in ((0, 0), (5, 20), (12, 1 << 20)):
        models = lm.fit(docs, codes=codes, hot=hot, filter_bits=9)
        assert len(models.codes) <= codes and len(models.keys) <= hot
        got = lm.score(docs, models).collect()
        assert len(got) == len(want) and all(r == want[r.doc_id] for r in got)


def test_bitmap_of_keys(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD_KEYS", 100)
    keys = np.random.default_rng(13).integers(0, 1 << 64, 700, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long").repartition(3)
    for bits in (7, 13, 20):
        got = lm._bitmap(lm._key_bits(df, bits), bits)
        places = np.unique(keys >> np.uint64(64 - bits))
        assert lm._is_set(got, places).all() and sum(int(x).bit_count() for x in got) == len(places)
