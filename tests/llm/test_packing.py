"""Packing: tokens against the tokenizer itself, exact round trip, and sequences against the lower bound."""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def tokens(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, want, sequence):
    """Every document's pieces are its tokens in order, and sequences are filled without gaps or overlaps."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for k, parts in by_doc.items():
        ids, at = want[k], 0
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        for r in parts:
            assert r.start == at and (r.length == sequence or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by_seq)


def test_query_packs_every_token(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: tokens(tokenizer, r.text) for r in docs}
    n = check(QUERIES["op3_pattern_packing"](spark, sf).collect(), want, 1024)
    assert n <= 1.03 * sum(map(len, want.values())) / 1024 + 1


ODD = [None, "", " ", "  \n\n x", "a" * 5000, "1" * 3000, "don't we'll  it's", "<|endoftext|> x", "日本語 text é ñ ́", "\x1c\x1d\x85\xa0 a\x0b", "\U0001f600" * 400, "x y " * 3000]


def test_odd_documents_round_trip(spark, tokenizer):
    rows = [(i, t, 1, 2) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, bucket int")
    want = {i: tokens(tokenizer, t) for i, t in enumerate(ODD)}
    check(packing.pack_documents(docs, 64).collect(), want, 64)
    parts = packing.written(packing.pieces(docs, sequence=64, with_ids=True), "test")
    packed = packing.pack(parts, 64)
    made = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert made[r.sequence_id].ids[r.offset : r.offset + r.length] == want[r.doc_id][r.start : r.start + r.length]
        assert r.length in made[r.sequence_id].lengths


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "same text")] * 50 + [(None, "same text")] * 50, "doc_id long, text string")
    rows = packing.pack_documents(docs, 16).collect()
    assert len(rows) == 100 and len({(r.sequence_id, r.offset) for r in rows}) == 100
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_added_tokens_count_as_the_library_counts_them(spark):
    rows = packing.pieces(spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string"), with_ids=True).collect()
    assert struct.unpack("<4I", rows[0].ids) == (64, 50256, 65, packing.END_OF_TEXT)


def test_words_give_the_tokenizers_ids(tokenizer):
    encode = packing.Encoder("byte_bpe_50k.json")
    for c in map(chr, [*range(1, 0x300), *range(0x2000, 0x2070), 0x20AC, 0x3000, 0xFEFF]):
        t = f"a{c}b {c} {c}{c}  {c}\n{c}'s '{c}1{c}{c} {c}"
        assert list(struct.unpack(f"<{len(encode(t)) // 4}I", encode(t))) == tokenizer.encode(t, add_special_tokens=False).ids, repr(c)


def test_patterns_fill_exactly_and_are_all():
    got = {tuple(p) for p in packing.fill_patterns(30)}
    want = {(a, b, c) for a in range(1, 31) for b in range(1, a + 1) for c in range(b + 1) if a + b + c == 30}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    lengths = [rng.integers(1, 257, 20_000), np.minimum(256, rng.geometric(0.03, 20_000)), rng.integers(100, 140, 5_000), np.full(7, 200)][seed]
    np.add.at(counts, lengths, 1)
    plan = packing.plan_patterns(counts, 256)
    used = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 256 and n > 0
        for v in pattern:
            used[v] += n
    assert used == Counter(lengths.tolist())
    plain = sum(n for _, n in packing.best_fit(counts, 256))
    assert sum(n for _, n in plan) <= 1.02 * plain + 1
