"""Every stage of the pipeline against brute force on what the stage before it kept."""

from __future__ import annotations

import importlib
import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import mixing, quality
from test_jaccard_join import brute



def test_stages(spark, sf, tmp_path):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "source_mix", "pattern_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.dtypes == before.dtypes
        kept.append(docs.collect())
    source = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    scores = quality.score(source, quality.fit(source, labels)).collect()
    assert {r.doc_id for r in kept[0]} == {r.doc_id for r in scores if r.score >= quality.THRESHOLD}
    first = {}
    for r in kept[0]:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[k] = min(r.doc_id, first.get(k, r.doc_id))
    assert sorted(r.doc_id for r in kept[1]) == sorted(first.values())
    groups = brute([(r.doc_id, r.text) for r in kept[1]])
    assert sorted(r.doc_id for r in kept[2]) == sorted(k for k, n, c in groups if k == c)
    plan = mixing.plan_mix(spark.read.parquet(f"{tmp_path}/2")).collect()
    copies = Counter({r.doc_id: r.copies for r in plan if r.copies})
    assert Counter(r.doc_id for r in kept[3]) == copies
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in kept[3]}
    # copies of a document are told apart by how often each of its pieces was seen
    seen, rows = Counter(), []
    by_place = defaultdict(list)
    for r in kept[4]:
        seen[r.doc_id, r.piece] += 1
        by_place[r.sequence_id].append((r.offset, r.length))
        if seen[r.doc_id, r.piece] == 1:
            rows.append(r)
    assert all(n == copies[k] for (k, _), n in seen.items())
    for parts in by_place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for k in want:
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(want[k])


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
