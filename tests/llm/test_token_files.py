from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import token_files
from plumbline.llm.queries import QUERIES
from plumbline.llm.tokens import Encoder

PLAIN = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))


def ids_of(text) -> list[int]:
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [token_files.END]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def brute(rows) -> list[tuple]:
    out, start = [], 0
    for key, text in rows:
        ids = ids_of(text)
        out.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = QUERIES["op13_token_files"](spark, sf)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == brute(docs)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_DOCUMENTS", 7)
    monkeypatch.setattr(token_files, "BUCKET_KEYS", 5)


def test_odd_rows_repeated_ids_and_keyed_access(spark, tmp_path, small_shards):
    long = "very long words " * 20_000
    rows = [(None, "no id"), (None, None), (5, ""), (-3, "minus"), (2**62, "large"), (1, long), (7, "a<|endoftext|>b")]
    rows += [(4, f"same id {i}") for i in range(30)] + [(6, "equal rows")] * 25 + [(8, "日本語 ﷽ \x00   é")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, occurrence int, h string")
    folder = str(tmp_path / "tokens")
    token_files.write(docs.repartition(5), folder)
    found = token_files.read(spark, folder, token_files.find(spark, folder, token_files.keys_of(docs)), with_ids=True).collect()
    assert len(found) == len(rows)
    want = sorted(((k is not None, k or 0), tuple(ids_of(t))) for k, t in rows)
    got = sorted(((r.doc_id is not None, r.doc_id or 0), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found)
    assert got == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens * 4 == len(r.ids) for r in found)
    ordered = sorted(found, key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0, r.occurrence) for r in ordered]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    manifest = token_files.read_manifest(spark, folder)
    assert manifest.count() > 5 and manifest.agg(F.sum("documents"), F.sum("ids")).first() == (len(rows), sum(r.n_tokens for r in found))

    reader = token_files.Reader(folder)
    for r in found:
        assert reader[r.doc_id, r.occurrence].astype("<u4").tobytes() == r.ids
    assert reader[-3].tolist() == ids_of("minus")
    for wrong in (99, (5, 1), (4, 30), (None, 2)):
        with pytest.raises(KeyError):
            reader[wrong]
    unknown = spark.createDataFrame([(i, 0) for i in range(100, 400)] + [(5, 0), (5, 0)], "doc_id long, occurrence int")
    assert [(r.doc_id, r.occurrence) for r in token_files.find(spark, folder, unknown).collect()] == [(5, 0)]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = str(tmp_path / "tokens")
    token_files.write(docs, folder)
    assert token_files.read_manifest(spark, folder).count() == 0
    assert token_files.read(spark, folder, token_files.find(spark, folder, token_files.keys_of(docs))).collect() == []
    with pytest.raises(KeyError):
        token_files.Reader(folder)[1]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 20_000):
        ids = rng.integers(-(2**63), 2**63 - 1, n)
        occurrences = rng.integers(0, 3, n).astype(np.uint64)
        function = token_files.PerfectHash.build(ids, occurrences)
        again = token_files.PerfectHash.from_bytes(function.to_bytes())
        assert sorted(again(ids, occurrences).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(np.array([1, 1]), np.zeros(2, np.uint64))


def test_encoder_gives_the_tokenizers_ids():
    encode = Encoder(token_files.TOKENIZER)
    texts = [
        "", " ", "  a  b ", "it's we'll I'M", "a\n\n b\t\tc\r\n", "x" * 5000, "1234,5 67.8%", "<|endoftext|>", "<|endoftext|", "¡Olé! ß–— “q” … €5",
        "日本語", "a b", "a\u0085b", "\x1c\x1d", "mixed 日本 and Latin", "trailing   ", "\n", "tab\there",
    ]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids, text
