from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

import compare
from plumbline.llm import fill_middle
from plumbline.llm.queries import ORACLES, QUERIES


def test_query_against_sql(spark, sf):
    assert compare.difference(QUERIES["op11_fill_middle"](spark, sf), compare.connect(sf), ORACLES["op11_fill_middle"]) is None


def by_hand(key, text, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < suffix_first else f"<P>{pre}<S>{suf}<M>{mid}"
    return key, len(units), "spm" if h[3] % 100 < suffix_first else "psm", len(pre), len(mid), out


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb"), (7, "a\r\nb\n"), (8, "has <S> mark\nx"), (9, "almost <P\n>x<\nS"),
    (10, "ünï\ncödé\n\U0001f600\n"), (11, "x" * 500_000), (12, "line\n" * 200_000), (None, "no id\nat all"), (13, "rep\neat"), (13, "rep\neat"), (-5, "<\n<\nP>\nS>\nM>"),
]


def test_odd_rows_and_round_trip(spark):
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in ODD], "doc_id long, text string, n int, output string")
    for options in ({}, {"rate": 40}, {"suffix_first": 0}, {"suffix_first": 100}):
        out = fill_middle.rewritten(docs, **options)
        back = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[5])
        assert sorted((tuple(r)[:6] for r in back), key=key) == sorted((by_hand(k, t, **options) for k, t in ODD), key=key)
        texts = sorted((t or "") for _, t in ODD)
        assert sorted(r.back for r in back) == texts
    assert {r.form for r in back} == {"plain", "spm"}
    assert fill_middle.rewritten(docs.limit(0)).collect() == []


def test_other_units_and_marks(spark):
    docs = spark.createDataFrame([(i, "some words in a row") for i in range(50)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    out = fill_middle.rewritten(docs, unit=r"\S+\s*", marks=marks)
    rows = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.n for r in rows} == {5} and {r.back for r in rows} == {"some words in a row"}
    assert len({(r.prefix_chars, r.middle_chars) for r in rows}) > 10
    partly = fill_middle.rewritten(docs, unit="[a-z]+").collect()  # does not match the blanks
    assert {r.n for r in partly} == {1}
