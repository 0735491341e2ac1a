"""Exact deduplication against a plain dictionary, and the filter's promises."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import compare
import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup as ed
from plumbline.llm.queries import ORACLES, QUERIES

TEXTS = [None, "", " ", "  \t", "a b", "a  b", "a b", "a\x0b\x0cb", " a b", "A b", "x" * 100_000, "x" * 100_000, "é", "é"]


def plain(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(k)
    out = []
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), h) for i in ids]
    return out


def key(r):
    return tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)


def test_query_equals_sql(spark, sf):
    assert compare.difference(QUERIES["op1_exact_dedup"](spark, sf), compare.connect(sf), ORACLES["op1_exact_dedup"]) is None


@pytest.mark.parametrize("words, share", [(ed.FILTER_WORDS, ed.HOT_SHARE), (2, 3)])
def test_odd_rows(spark, monkeypatch, words, share):
    """Also with a filter that is full and with a few hot groups: the result is exact all the same."""
    monkeypatch.setattr(ed, "FILTER_WORDS", words)
    monkeypatch.setattr(ed, "HOT_SHARE", share)
    rows = list(enumerate(TEXTS)) + [(None, "a b"), (None, "no other"), (None, "no other"), (4, "a b"), (4, "a b"), (77, "hot")] + [(100 + i, "hot") for i in range(300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, shared int").repartition(5)
    got = ed.repeat_groups(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(plain(rows), key=key)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    left = ed.drop_repeats(df)
    assert left.dtypes == df.dtypes
    stays = {(keep, h) for _, keep, _, h in plain(rows)}
    rest = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in left.collect()]
    assert len(rest) == len(stays) and set(rest) == stays


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ed.repeat_groups(df).collect() == [] and ed.drop_repeats(df).collect() == []


def test_filter_clears_only_hashes_that_occur_once(spark):
    df = spark.range(20_000).select((F.col("id") % 15_000).alias("h"))
    bloom = ed.repeat_filter(df, "h")
    assert bloom.count() <= ed.FILTER_WORDS
    flags = ed.probe(df, bloom, "h", "hit").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bool_and("hit").alias("hit"))
    assert flags.where("n > 1 AND NOT hit").count() == 0
    assert flags.where("n = 1 AND hit").count() < 200  # of 10 000: false positives are few
    shuffled = ed.probe(df, bloom, "h", "hit").where("NOT hit")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shuffled and "SortMergeJoin" not in shuffled
