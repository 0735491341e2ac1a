from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import compare
from plumbline.llm import collocations
from plumbline.llm.queries import ORACLES, QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest, least, covered=80, top=2000) -> list[tuple]:
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in candidates.items():
            around = [c for q, c in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * c >= covered * a for c in around):
                continue
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        scored.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(scored[:top])]
    return sorted(out)


def mined(df, **options) -> list[tuple]:
    out = collocations.mine(df, **options)
    assert out.columns == COLUMNS and set(dict(out.dtypes).values()) == {"string", "bigint"}
    return sorted(map(tuple, out.collect()))


def test_query_against_sql(spark, sf):
    assert compare.difference(QUERIES["op12_collocations"](spark, sf), compare.connect(sf), ORACLES["op12_collocations"]) is None


@pytest.mark.parametrize("longest", [2, 3, 4, 5])
def test_random_texts_against_brute_force(spark, longest):
    rng = random.Random(longest)
    vocabulary = ["a", "b", "A", "c", "ü", "\U0001f600", "z", "e'", "0"]
    passage = " ".join(rng.choices([f"w{i}" for i in range(40)], k=30))
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", ", ", "\n", ". "]) for _ in range(rng.randrange(40))]
        rows.append(("".join(words) + (passage if i % 3 else "") + rng.choice(["", " a a a a a a"]), rng.choice(["x", "y", None, "und"])))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute(rows, longest, 6)
    assert len(want) > 20
    assert mined(df, longest=longest, least=6) == want
    assert mined(df, longest=longest, least=6, top=3) == brute(rows, longest, 6, top=3)


def test_odd_rows(spark):
    long = "to be or not to be " * 5000
    rows = [(None, None), ("", "x"), (long, None), ("only, short. pieces; here", "x")] + [("Ab aB ab AB", "y")] * 20 + [("À à", "y")] * 9
    df = spark.createDataFrame([(t, g, "w", 1) for t, g in rows], "text string, lang string, phrase string, n int")
    assert mined(df) == brute(rows, 4, 30)
    assert mined(df, least=5) == brute(rows, 4, 5)
    assert mined(df.limit(0)) == []
    assert mined(df.limit(0).unionByName(df.where("lang = 'x'"))) == []


def test_compaction_keeps_every_edge_and_joins_passages(spark):
    passage = [f"p{i}" for i in range(60)]
    grams = [(" ".join(passage[i : i + 4]), 50) for i in range(57)] + [("a a a a", 9), ("b c b c", 9), ("c b c b", 9), ("x p4 p5 p6", 3)]
    edges = spark.createDataFrame([("g", p, n) for p, n in grams], "lang string, phrase string, f long")
    paths = collocations.compact(edges).collect()
    back = [(" ".join(r.words[i : i + 4]), w) for r in paths for i, w in enumerate(r.weights)]
    assert sorted(back) == sorted(grams)
    assert len(paths) < 25 and max(len(r.weights) for r in paths) > 4
    inner = collocations.contained(collocations.compact(edges)).groupBy("phrase").agg(F.max("f").alias("f")).collect()
    want = Counter()
    for p, n in grams:
        words = p.split()
        for j in (2, 3):
            for i in range(5 - j):
                q = " ".join(words[i : i + j])
                want[q] = max(want[q], n)
    assert {r.phrase: r.f for r in inner} == dict(want)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = [("a b c d e f g", "x"), ("b c d", "x"), ("q r s t", "x")] * 12
    monkeypatch.setattr(collocations, "BITMAP", 64)
    assert mined(spark.createDataFrame(rows, "text string, lang string"), least=10) == brute(rows, 4, 10)


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**18
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long")
    got = row.select(F.expr("cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")).first()[0]
    assert got == 1_000_000
