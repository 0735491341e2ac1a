"""Cross-entropy difference scores from two matched n-gram models over one vocabulary.

Both models are interpolated bigram models of words in lower case. The target model counts the rows marked as target,
the background model all rows. They are matched: same vocabulary (words seen `min_count` times in the whole corpus, all
others are one unknown word), same bigrams (those seen `min_count` times), same smoothing, and background counts scaled
to the target's number of words, so that smoothing weighs the same in both.

Counts are exact and cover the whole corpus, at any size. Words are counted first. The most frequent ones, `CODES` at most,
get numbers, and a bigram of two numbered words is one of 42 bits, which a bijection spreads over the key space: tasks add up
what they read and send sorted numbers as differences with counts, in blocks to buckets of the key space, which takes a few
bytes a bigram at any size. A word seen fewer than `min_count` times is in no bigram of the model, so that nothing else is to
be counted while all others have numbers. Beyond that, bigrams with a frequent word that has none are counted by hashes,
after a pass over cells of 40 hash bits that keeps out those that are rare for certain; what gets by because cells or bits
are shared costs time and changes no count.

The models are tables of what every word and bigram
adds to a document's loss. A word w after v costs -log p(w) of the
interpolated unigram model, plus log(1 + h(v) / H) for backing off from v, minus log(1 + c(v,w) / (H p(w))) if the
bigram is in the model (c: its count, h(v): kept bigrams that begin with v, H: `HISTORY_WEIGHT`). What differs from an
unknown word is stored by number for words that have one, else by a 64-bit key, so that a key that no table holds adds nothing.
Losses are integers, in units of 1 / `UNIT`, and sums therefore the same in any order.

Scoring: what numbered words add is broadcast, and of the keys the most frequent, `HOT` at most, with a bitmap of all others. The
remaining keys that the bitmap knows go to buckets of the key space in blocks, sorted and as differences with the rows that ask; a
bucket holds its share of the table and sends each block the sums of its rows. How much is broadcast never changes a score.

A document's score is its mean per-word loss under the target minus that under the background: the lower, the more it
looks like the target.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.batches import WordHasher, mixed, text_pieces
from plumbline.llm.tables import free, text_or_empty, written

MIN_COUNT = 3
HISTORY_WEIGHT = 20.0
WORD_WEIGHT = 0.1
UNIT = 1 << 20
HOT = 1 << 21
FILTER_BITS = 27
HELD_WORDS = 1 << 21
HELD_COUNTS = 6 << 20
CODE_BITS = 21
CODES = (1 << CODE_BITS) - 1  # words with a number, from 1 on; 0 is no word
HELD_PAIRS = 1 << 22
CELL_BITS = 40
CELL_BYTES = 5
BUCKET_BYTES = 1 << 20  # of text, for one bucket of cells
COUNT_BYTES = 1 << 24  # of text, for one bucket of counts
LOOKUP_BYTES = 1 << 26  # of text, for one bucket of keys to look up
HELD_KEYS = 1 << 20
BATCH_ROWS = 1 << 16
BROADCAST_LABELS = 1_000_000
TURN = 17
SPREAD = 0x2545F4914F6CDD1D
_NUMBERS = np.uint64((1 << 2 * CODE_BITS) - 1)
_EVEN = np.uint64((1 << 64) - 2)


@dataclasses.dataclass(frozen=True)
class Models:
    """unknown: loss of an unknown word under (target, background); codes: the words that have numbers, sorted; own, back: what
    these add under both, and what backing off from them adds, by number; keys, values: the hot keys, sorted, and what they add;
    bits: bitmap over the first bits of all other keys; cold: those as a table (key, target, background)."""

    unknown: tuple[int, int]
    codes: np.ndarray
    own: np.ndarray
    back: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    bits: np.ndarray
    cold: DataFrame


def _first_words(edges: np.ndarray) -> np.ndarray:
    """Positions of the first words of the texts that have words."""
    return edges[:-1][np.diff(edges) > 0]


def _after(first: np.ndarray, n: int) -> np.ndarray:
    """Positions of words that have one before them in their text."""
    inner = np.ones(n, bool)
    inner[_first_words(first)] = False
    return np.flatnonzero(inner)


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left << np.uint64(TURN) | left >> np.uint64(64 - TURN)) ^ right


def _named(words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Names of words given by their even hashes: their numbers, or the hashes with the first bit set."""
    if not len(codes):
        return words | np.uint64(1 << 63)
    at = np.minimum(np.searchsorted(codes, words), len(codes) - 1)
    return np.where(codes[at] == words, at.astype(np.uint64) + np.uint64(1), words | np.uint64(1 << 63))


def _keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of the words w after v by name, of w alone (v = 0), of backing off from v (w = 0). Those of numbered words are
    even and different, those with other words odd hashes."""
    x = v << np.uint64(CODE_BITS) | w
    for _ in range(2):
        x = x * np.uint64(SPREAD) & _NUMBERS
        x = x ^ (x >> np.uint64(CODE_BITS))
    x <<= np.uint64(64 - 2 * CODE_BITS)
    other = (v > np.uint64(CODES)) | (w > np.uint64(CODES))
    if other.any():
        x[other] = _pair_key(mixed(v[other]), mixed(w[other])) | np.uint64(1)
    return x


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers (v, w) of even keys."""
    x = keys >> np.uint64(64 - 2 * CODE_BITS)
    for _ in range(2):
        x = x ^ (x >> np.uint64(CODE_BITS))
        x = x * np.uint64(pow(SPREAD, -1, 1 << 2 * CODE_BITS)) & _NUMBERS
    return x >> np.uint64(CODE_BITS), x & np.uint64(CODES)


def _batches(columns: list[np.ndarray], names: list[str]):
    for at in range(0, len(columns[0]), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BATCH_ROWS]) for c in columns], names=names)


def _cells(keys: np.ndarray) -> np.ndarray:
    return mixed(keys) >> np.uint64(64 - CELL_BITS)


def _packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells as differences, and their counts up to 255, in planes of bytes."""
    steps = np.diff(cells, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :CELL_BYTES]
    planes = np.concatenate([steps.T, np.minimum(counts, 255).astype(np.uint8)[None]])
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, (CELL_BYTES + 1) * n, asbytes=True), np.uint8).reshape(-1, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :CELL_BYTES] = planes[:CELL_BYTES].T
    return np.cumsum(steps.view(np.uint64)[:, 0], dtype=np.uint64), planes[CELL_BYTES].astype(np.int64)


def frequent_cells(docs: DataFrame, text: str, min_count: int, filter_bits: int, codes: np.ndarray | None = None) -> np.ndarray:
    """Bitmap over the first bits of cells, set for all bigrams that occur `min_count` times, and for few others; with
    `codes`, of the bigrams in which a word has no number."""
    known = docs.sparkSession.sparkContext.broadcast(codes)
    rows = docs.select(text_or_empty(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bucket_bits = min(CELL_BITS - 1, (size // BUCKET_BYTES).bit_length())

    def count(batches):
        hasher, held, n = WordHasher(), [], 0

        def summed():
            cells = np.concatenate(held)
            held.clear()
            cells.sort()
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            counts, cells = np.diff(np.r_[starts, len(cells)]), cells[starts]
            bucket = (cells >> np.uint64(CELL_BITS - bucket_bits)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[at[1:], len(cells)]
            for k in range(0, len(at), 1024):
                spans = list(zip(at[k : k + 1024].tolist(), ends[k : k + 1024].tolist()))
                columns = [pa.array(bucket[at[k : k + 1024]]), pa.array([b - a for a, b in spans], pa.int32())]
                packed = pa.array([_packed(cells[a:b], counts[a:b]) for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, packed], names=["bucket", "size", "cells"])

        for batch in batches:
            for _, _, data, edges in text_pieces(batch.column(0)):
                words, first = hasher(data, edges)
                if len(words):
                    at = _after(first, len(words))
                    if known.value is not None:
                        words, other = _unnumbered(words, at, known.value)
                        at = at[other]
                    held.append(_cells(_pair_key(words[at - 1], words[at])))
                    n += len(at)
                if n > HELD_PAIRS:
                    yield from summed()
                    n = 0
        if n:
            yield from summed()

    def merge(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        parts = [_unpacked(n, data) for n, data in zip(found["size"].to_pylist(), found["cells"].to_pylist())]
        cells, counts = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(cells)
        cells, counts = cells[order], np.where(counts[order] == 255, min_count, counts[order])
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        place = cells[starts][np.add.reduceat(counts, starts) >= min_count] >> np.uint64(CELL_BITS - filter_bits)
        return _bits_at(place)

    cells = rows.mapInArrow(count, "bucket long, size int, cells binary").groupBy("bucket").applyInArrow(merge, "at long, bits long")
    return _bitmap(cells.groupBy("at").agg(F.bit_or("bits").alias("bits")), filter_bits)


def _bits_at(place: np.ndarray) -> pa.Table:
    """(at, bits): the 64-bit words of the bitmap in which the sorted places are set."""
    at, first = np.unique(place >> np.uint64(6), return_index=True)
    bit = np.uint64(1) << (place & np.uint64(63))
    bits = np.bitwise_or.reduceat(bit, first) if len(bit) else bit
    return pa.table({"at": at.astype(np.int64), "bits": bits.view(np.int64)})


def _key_bits(keys: DataFrame, filter_bits: int) -> DataFrame:
    """(at, bits): the bitmap over the first bits of the column `keys`; places go to buckets of them as differences."""
    low = np.uint64(64 - filter_bits)

    def pack(batches):
        def packed():
            place = np.unique(np.concatenate(held) >> low)
            held.clear()
            columns = _in_buckets(place << low, [], min(6, filter_bits - 6))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "size", "data"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            n += batch.num_rows
            if n > HELD_KEYS:
                yield from packed()
                n = 0
        if n:
            yield from packed()

    def merge(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        parts = [_from_planes(n, data, 0)[0] for n, data in zip(found["size"].to_pylist(), found["data"].to_pylist())]
        return _bits_at(np.sort(np.concatenate(parts)) >> low)

    return keys.mapInArrow(pack, "bucket long, size long, data binary").groupBy("bucket").applyInArrow(merge, "at long, bits long")


def _bitmap(words: DataFrame, filter_bits: int) -> np.ndarray:
    """The bitmap of (at, bits), one row per 64-bit word that is not 0: 2^21 rows at 27 bits."""
    filled = words.toArrow()
    bits = np.zeros(1 << (filter_bits - 6), np.uint64)
    bits[filled["at"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return bits


def _is_set(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)) == 1


def _unnumbered(words: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of words given by their hashes, whether the word at `at` or the one before has no number)."""
    kinds, which = np.unique(words & _EVEN, return_inverse=True)
    names = _named(kinds, codes)[which]
    other = names > np.uint64(CODES)
    return names, other[at] | other[at - 1]


def _added_up(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(even keys, sorted; how often they occur; how often with their last bit set). Sorts `keys` in place."""
    keys.sort()
    starts = np.flatnonzero(np.r_[True, keys[1:] ^ keys[:-1] > np.uint64(1)])
    marks = np.add.reduceat(keys & np.uint64(1), starts).astype(np.int64)
    return keys[starts] & _EVEN, np.diff(np.r_[starts, len(keys)]), marks


def _key_counts(rows: DataFrame, keys_of, found_of, schema: str, bucket_bits: int) -> DataFrame:
    """`found_of(keys, n, t)` for each bucket of the key space: its keys, sorted, and how often `keys_of(words, first)`, which
    gives (even keys, places of their words), has them in all rows (text, target) and in the target's."""

    def count(batches):
        hasher, held, n = WordHasher(), [], 0

        def packed():
            keys = np.concatenate(held)
            held.clear()
            keys, *sums = _added_up(keys)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _in_buckets(keys, sums, bucket_bits)], names=["bucket", "size", "data"])

        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            for a, b, data, edges in text_pieces(batch.column(0)):
                words, first = hasher(data, edges)
                if not len(words):
                    continue
                keys, at = keys_of(words & _EVEN, first)
                held.append(keys | np.repeat(wanted[a:b], np.diff(first))[at])
                n += len(keys)
                if n > HELD_COUNTS:  # hand over what has gathered: memory stays bounded, buckets make the sum
                    yield from packed()
                    n = 0
        if n:
            yield from packed()

    def merge(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        parts = [_from_planes(n, data, 2) for n, data in zip(found["size"].to_pylist(), found["data"].to_pylist())]
        keys, *counts = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return found_of(keys[starts], *(np.add.reduceat(c[order], starts) for c in counts))

    return rows.mapInArrow(count, "bucket long, size long, data binary").groupBy("bucket").applyInArrow(merge, schema)


def _marked_texts(docs: DataFrame, text: str, target: str) -> DataFrame:
    return docs.select(text_or_empty(text).alias("text"), F.coalesce(F.col(f"`{target}`").cast("boolean"), F.lit(False)).alias("target"))


def word_counts(docs: DataFrame, text: str, target: str, min_count: int, bucket_bits: int) -> DataFrame:
    """(w, n, t): occurrences of the words, by their even hashes, in all rows and in the target's; words that occur fewer than
    `min_count` times are added up under null."""

    def found(words: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.Table:
        often = n >= min_count
        w = pa.concat_arrays([pa.array(words[often].view(np.int64)), pa.nulls(1, pa.int64())])
        return pa.table([w, *(np.r_[c[often], c[~often].sum()] for c in (n, t))], names=["w", "n", "t"])

    return _key_counts(_marked_texts(docs, text, target), lambda words, first: (words, slice(None)), found, "w long, n long, t long", bucket_bits)


def pair_counts(
    docs: DataFrame, text: str, target: str, min_count: int, filter_bits: int, bucket_bits: int, codes: np.ndarray, whole: bool
) -> DataFrame:
    """(v, w, n, t): occurrences of word w after v, by their names, if there are `min_count`, in all rows and in the target's.
    `whole`: all words that occur `min_count` times are among `codes`."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def keys_of(words, first):
        at = _after(first, len(words))
        names, other = _unnumbered(words, at, shared.value)
        at = at[~other]
        return _keys(names[at - 1], names[at]), at

    def found(keys: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.Table:
        often = n >= min_count
        v, w = _numbers(keys[often])
        order = np.lexsort((w, v))
        columns = v.view(np.int64), w.view(np.int64), n[often], t[often]
        return pa.table([c[order] for c in columns], names=["v", "w", "n", "t"])

    pairs = _key_counts(_marked_texts(docs, text, target), keys_of, found, "v long, w long, n long, t long", bucket_bits)
    return pairs if whole else pairs.unionByName(_unnumbered_pairs(docs, text, target, min_count, filter_bits, codes))


def _unnumbered_pairs(docs: DataFrame, text: str, target: str, min_count: int, filter_bits: int, codes: np.ndarray) -> DataFrame:
    """`pair_counts` of the bigrams in which a word has no number."""
    bits = frequent_cells(docs, text, min_count, filter_bits, codes) if min_count > 1 else np.full(1 << (filter_bits - 6), ~np.uint64(0))
    shared = docs.sparkSession.sparkContext.broadcast((bits, codes))

    def count(batches):
        hasher, held, n = WordHasher(), [], 0

        def summed():
            left, right, marks = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((right, left))
            left, right, marks = left[order], right[order], marks[order]
            starts = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
            ends = np.r_[starts[1:], len(left)]
            yield from _batches(
                [left[starts].view(np.int64), right[starts].view(np.int64), ends - starts, np.add.reduceat(marks, starts, dtype=np.int64)],
                ["v", "w", "n", "t"],
            )

        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, edges in text_pieces(batch.column(0)):
                words, first = hasher(data, edges)
                if not len(words):
                    continue
                marks = np.repeat(wanted[a:b], np.diff(first))
                at = _after(first, len(words))
                words, other = _unnumbered(words, at, shared.value[1])
                at = at[other]
                cells = _cells(_pair_key(words[at - 1], words[at]))
                at = at[_is_set(shared.value[0], cells >> np.uint64(CELL_BITS - filter_bits))]
                held.append((words[at - 1], words[at], marks[at]))
                n += len(at)
                if n > HELD_WORDS:  # hand over what has gathered: memory stays bounded, the sum is made by Spark
                    yield from summed()
                    n = 0
        if n:
            yield from summed()

    counts = _marked_texts(docs, text, target).mapInArrow(count, "v long, w long, n long, t long")
    # rows of one left word stay together, which compresses well; the many of a frequent one are split
    counts = counts.withColumn("part", F.col("w").bitwiseAND(15)).repartition("v", "part")
    counts = counts.groupBy("v", "part", "w").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).drop("part")
    return counts.where(F.col("n") >= min_count)


def _cut(counts: DataFrame, room: int) -> int:
    """The least of the bands of the largest counts that fit together; at most eight bands to a power of two."""
    cut = 1 << 30
    for r in sorted(counts.groupBy("band").count().collect(), key=lambda r: -r.band):
        if r["count"] > room:
            break
        cut, room = r.band, room - r["count"]
    return cut


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int32)


def fit(
    docs: DataFrame,
    text: str = "text",
    target: str = "target",
    min_count: int = MIN_COUNT,
    hot: int = HOT,
    filter_bits: int = FILTER_BITS,
    codes: int = CODES,
) -> Models:
    """Both models from `docs`; `target` marks the target's rows (null: not one).

    Null and empty texts count nothing, repeated rows count every time, and an empty table gives models in which every
    word is unknown. Very long texts are counted whole. Other columns of `docs` are not read. Hashes of 62 bits stand for
    words and for bigrams of words without numbers: two of them share one with a chance of about 10^-19 a pair.
    """
    size = docs.select(text_or_empty(text).alias("text")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bucket_bits = max(1, (size // COUNT_BYTES).bit_length())
    band = F.floor(8 * F.log2("n")).cast("int").alias("band")
    counted = written(word_counts(docs, text, target, min_count, bucket_bits), "words")
    words = counted.where("w IS NOT NULL")
    total = counted.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "t")],
        *[F.coalesce(F.sum(F.when(F.col("w").isNull(), F.col(c))), F.lit(0)).alias(f"rare_{c}") for c in ("n", "t")],
        F.count("w").alias("size"),
    ).first()
    scale = {"t": 1.0, "n": total.t / total.n if total.t else 1.0}
    mass = {c: scale[c] * total[c] + WORD_WEIGHT * (total.size + 1) for c in "tn"}
    unknown = {c: (scale[c] * total[f"rare_{c}"] + WORD_WEIGHT) / mass[c] for c in "tn"}

    def chance(c: str, n: np.ndarray) -> np.ndarray:
        return (scale[c] * n + WORD_WEIGHT) / mass[c]

    def own(c: str, n: np.ndarray) -> np.ndarray:
        return _units(np.log(unknown[c] / chance(c, n)))

    def back(c: str, n: np.ndarray) -> np.ndarray:
        return _units(np.log1p(scale[c] * n / HISTORY_WEIGHT))

    least = _cut(words.select(band), codes)
    top = words.where(band >= least).toArrow()
    known = top["w"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, seen = known[order], {c: np.r_[0, top[c].to_numpy()[order]] for c in "nt"}
    whole = len(known) == total.size
    pairs = written(pair_counts(docs, text, target, min_count, filter_bits, bucket_bits, known, whole), "ngrams")
    begun = pairs.groupBy("v").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    begun = begun if whole else written(begun, "begun")
    found = begun.where("v > 0").toArrow()
    values_own, values_back = np.zeros((2, 2, len(known) + 1), np.int32)
    for k, c in enumerate("tn"):
        values_own[k, 1:] = own(c, seen[c][1:])
        values_back[k, found["v"].to_numpy()] = back(c, found[c].to_numpy())

    rows = pairs.select("v", "w", "n", "t", F.lit(0).cast("long").alias("wn"), F.lit(0).cast("long").alias("wt"))
    if not whole:  # words without a number: names are negative
        others = words.where(band < least).select(F.col("w").bitwiseOR(F.lit(-1 << 63)).alias("w"), "n", "t")
        counts = others.select("w", F.col("n").alias("wn"), F.col("t").alias("wt"))
        rows = rows.where("w > 0").unionByName(pairs.where("w < 0").join(counts, "w"))
        zeros = [F.lit(0).cast("long").alias(c) for c in ("wn", "wt")]
        none = F.lit(0).cast("long")
        rows = rows.unionByName(others.select(none.alias("v"), "w", "n", "t", *zeros))
        rows = rows.unionByName(begun.where("v < 0").select("v", none.alias("w"), "n", "t", *zeros))
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def add(batches):
        for batch in batches:
            r = dict(zip(batch.schema.names, (c.to_numpy() for c in batch.columns)))
            n, code = {"n": r["n"], "t": r["t"]}, np.maximum(r["w"], 0)
            out = []
            for c in "tn":
                p = chance(c, np.where(code > 0, shared.value[c][code], r[f"w{c}"]))
                pair = _units(-np.log1p(scale[c] * n[c] / (HISTORY_WEIGHT * p)))
                out.append(np.where(r["v"] == 0, own(c, n[c]), np.where(r["w"] == 0, back(c, n[c]), pair)))
            keys = _keys(r["v"].view(np.uint64), r["w"].view(np.uint64)).view(np.int64)
            bands = np.floor(8 * np.log2(n["n"])).astype(np.int32)
            kept = (out[0] != 0) | (out[1] != 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (keys, bands, *out)], names=["key", "band", "dt", "dn"])

    deltas = written(rows.mapInArrow(add, "key long, band int, dt int, dn int"), "deltas")
    cut = _cut(deltas, hot)
    top = deltas.where(F.col("band") >= cut).select("key", "dt", "dn").toArrow()
    keys = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = np.stack([top[c].to_numpy()[order] for c in ("dt", "dn")])
    cold = deltas.where(F.col("band") < cut).select("key", F.col("dt").alias("target"), F.col("dn").alias("background"))
    bits = _bitmap(_key_bits(cold.select("key"), filter_bits), filter_bits)
    return Models(tuple(round(-math.log(unknown[c]) * UNIT) for c in "tn"), known, values_own, values_back, keys[order], values, bits, cold)


def _found(keys: np.ndarray, hot: np.ndarray, values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what the hot ones of `keys` add under both models, which of the others may be in the cold table)."""
    out = np.zeros((2, len(keys)), np.int64)
    hit = np.zeros(len(keys), bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        hit = hot[at] == keys
        out[:, hit] = values[:, at[hit]]
    place = keys >> np.uint64(64 - (len(bits).bit_length() + 5))
    return out, ~hit & _is_set(bits, place)


def _piece(words: np.ndarray, first: np.ndarray, codes: np.ndarray, own: np.ndarray, back: np.ndarray, *table: np.ndarray):
    """Of texts' word hashes: (sums of what numbered words and hot keys add, per text; keys to look up; where each text's keys begin)."""
    at = _after(first, len(words))
    followed = at - 1
    kinds, which = np.unique(words & _EVEN, return_inverse=True)
    names = _named(kinds, codes)
    other = np.flatnonzero(names > np.uint64(CODES))
    none = np.zeros(len(other), np.uint64)
    numbers = names.astype(np.int64)
    numbers[other] = 0
    sums_own, sums_back = (a[:, numbers].astype(np.int64) for a in (own, back))
    own_keys, back_keys = _keys(none, names[other]), _keys(names[other], none)
    own_cold, back_cold = np.zeros((2, len(kinds)), bool)
    sums_own[:, other], own_cold[other] = _found(own_keys, *table)
    sums_back[:, other], back_cold[other] = _found(back_keys, *table)
    place = np.zeros(len(kinds), np.int64)
    place[other] = np.arange(len(other))
    pair_keys = _keys(names[which[followed]], names[which[at]])
    pair, pair_cold = _found(pair_keys, *table)
    total = sums_own[:, which]
    total[:, followed] += sums_back[:, which[followed]]
    total[:, at] += pair
    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(total, axis=1)], axis=1)
    sums = sums[:, first[1:]] - sums[:, first[:-1]]
    own_at = np.flatnonzero(own_cold[which])
    back_at = followed[back_cold[which[followed]]]
    pair_at = at[pair_cold]
    places = np.concatenate([own_at, back_at, pair_at])
    keys = np.concatenate([own_keys[place[which[own_at]]], back_keys[place[which[back_at]]], pair_keys[pair_cold]])
    order = np.argsort(places, kind="stable")
    return sums, keys[order], np.searchsorted(places[order], first)


def _planes(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted 64-bit numbers as differences, and columns of 64-bit integers, in planes of bytes."""
    numbers = [np.diff(keys, prepend=np.uint64(0)), *columns]
    planes = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T for c in numbers])
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def _from_planes(n: int, data: bytes, width: int) -> list[np.ndarray]:
    """The numbers and `width` columns that `_planes` packed."""
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * (width + 1) * n, asbytes=True), np.uint8).reshape(width + 1, 8, n)
    steps, *columns = (np.ascontiguousarray(p.T).view(np.int64)[:, 0] for p in planes)
    return [np.cumsum(steps.view(np.uint64), dtype=np.uint64), *columns]


def _by_bucket(keys: np.ndarray, columns: list[np.ndarray], bucket_bits: int) -> tuple[list[int], list[int], list[bytes]]:
    """(buckets, sizes, packed keys and columns), one entry per bucket of the key space that has keys."""
    order = np.argsort(keys)
    return _in_buckets(keys[order], [c[order] for c in columns], bucket_bits)


def _in_buckets(keys: np.ndarray, columns: list[np.ndarray], bucket_bits: int) -> tuple[list[int], list[int], list[bytes]]:
    """`_by_bucket` of sorted keys."""
    bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[at[1:], len(keys)]
    data = [_planes(keys[a:b], [c[a:b] for c in columns]) for a, b in zip(at.tolist(), ends.tolist())]
    return bucket[at].tolist(), (ends - at).tolist(), data


def _looked_up(asked: DataFrame, cold: DataFrame, bucket_bits: int) -> DataFrame:
    """(row, target, background): what the cold keys that rows ask for add up to, from blocks (bucket, base, size, data) of
    keys and rows, which count from the block's base. All keys of a row are in blocks of one base."""

    def pack(batches):
        def packed():
            keys, *values = (np.concatenate(c) for c in zip(*held))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _by_bucket(keys.view(np.uint64), values, bucket_bits)], names=["bucket", "size", "data"])

        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy().astype(np.int64) for c in batch.columns])
            n += batch.num_rows
            if n > HELD_KEYS:
                yield from packed()
                n = 0
        if n:
            yield from packed()

    def look_up(key: tuple[pa.Scalar, ...], asked: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and found.num_rows:
            parts = [_from_planes(n, data, 2) for n, data in zip(found["size"].to_pylist(), found["data"].to_pylist())]
            keys, *values = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(keys)
            keys, values = keys[order], [v[order] for v in values]
            for base, n, data in zip(asked["base"].to_pylist(), asked["size"].to_pylist(), asked["data"].to_pylist()):
                wanted, row = _from_planes(n, data, 1)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                at, row = at[hit], row[hit]
                if len(row):
                    by_row = np.argsort(row, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(row[by_row]) != 0])
                    sums = [np.add.reduceat(v[at[by_row]], starts) for v in values]
                    out.append((base, len(starts), _planes(row[by_row][starts].view(np.uint64), sums)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.binary()))], names=["base", "size", "data"])

    def add(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        parts = [_from_planes(n, data, 2) for n, data in zip(found["size"].to_pylist(), found["data"].to_pylist())]
        row, *values = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(row, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])
        sums = [np.add.reduceat(v[order], starts) for v in values]
        return pa.table([row[order][starts].view(np.int64) + key[0].as_py(), *sums], names=["row", "target", "background"])

    table = cold.select("key", "target", "background").mapInArrow(pack, "bucket long, size long, data binary")
    sums = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(look_up, "base long, size long, data binary")
    return sums.groupBy("base").applyInArrow(add, "row long, target long, background long")


def score(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """`docs` without `text`, plus n_words, loss_target, loss_background (means per word) and score (their difference).

    A null or empty text has no words and null losses and score. Rows are scored one by one and numbered where they are
    read, so repeated rows give repeated results, and an empty table an empty one. Very long texts are scored whole, by
    one task up to the shuffle. Columns of `docs` with the names of the results are replaced.
    """
    own = ("n_words", "loss_target", "loss_background", "score")
    keep = [c for c in docs.columns if c != text and c.lower() not in own]
    names = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*names, text_or_empty(text).alias("text"))
    part = docs.select(*names, *[F.lit(0).alias(c) for c in own])
    row, more, target, background, bucket, size, data, found_t, found_b = (
        free(part, c) for c in ("row", "found_row", "target_sum", "background_sum", "bucket", "size", "data", "found_target", "found_background")
    )
    whole = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bucket_bits = max(1, (whole // LOOKUP_BYTES).bit_length())
    shared = docs.sparkSession.sparkContext.broadcast((models.codes, models.own, models.back, models.keys, models.values, models.bits))

    names_out = [*keep, "n_words", row, target, background, bucket, size, data]

    def run(batches):
        hasher, number = WordHasher(), TaskContext.get().partitionId() << 40
        held, n, base = [], 0, number

        def block():  # what the rows since `base` ask for, in rows of its own kind
            keys, rows_of = (np.concatenate(c) for c in zip(*held))
            held.clear()
            columns = [pa.array(c, t) for c, t in zip(_by_bucket(keys, [rows_of - base], bucket_bits), (pa.int64(), pa.int64(), pa.binary()))]
            none, m = pa.nulls(len(columns[0]), pa.int64()), len(columns[0])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in types), none, pa.array(np.full(m, base)), none, none, *columns], names=names_out)

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            for a, b, text_bytes, edges in text_pieces(batch.column(batch.num_columns - 1)):
                words, first = hasher(text_bytes, edges)
                sums, cold, begin = _piece(words, first, *shared.value)
                numbers = np.arange(number, number + b - a)
                none = [pa.nulls(b - a, t) for t in (pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns[:-1], pa.array(np.diff(first)), pa.array(numbers), pa.array(sums[0]), pa.array(sums[1]), *none],
                    names=names_out,
                )
                number += b - a
                if len(cold):
                    held.append((cold, np.repeat(numbers, np.diff(begin))))
                    n += len(cold)
                if n > HELD_KEYS:
                    yield from block()
                    n, base = 0, number
        if n:
            yield from block()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    more_fields = f"n_words long, `{row}` long, `{target}` long, `{background}` long, `{bucket}` long, `{size}` long, `{data}` binary"
    read = written(rows.mapInArrow(run, ", ".join([*fields, more_fields])), "losses")
    asked = read.where(F.col(bucket).isNotNull()).select(*[F.col(c).alias(n) for c, n in ((bucket, "bucket"), (row, "base"), (size, "size"), (data, "data"))])
    found = _looked_up(asked, models.cold, bucket_bits)
    read = read.where(F.col(bucket).isNull()).drop(bucket, size, data).join(found.toDF(more, found_t, found_b), F.col(row) == F.col(more), "left")

    def mean(base: int, hot: str, cold: str) -> Column:
        units = F.col("n_words") * base + F.col(hot) + F.coalesce(F.col(cold), F.lit(0))
        return F.when(F.col("n_words") > 0, units / F.col("n_words") / UNIT)

    losses = mean(models.unknown[0], target, found_t), mean(models.unknown[1], background, found_b)
    return read.select(*names, "n_words", losses[0].alias("loss_target"), losses[1].alias("loss_background"), (losses[0] - losses[1]).alias("score"))


def marked(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` with a column target: whether the row's id is among `ids` (one column, doc_id).

    Ids are broadcast while their number is small, and joined by a shuffle beyond that. Null ids mark nothing, rows with
    a null id are not marked, repeated ids count once, and a column target of `docs` is replaced. Texts are not looked at.
    """
    key, mark = free(docs, "marked_id"), free(docs, "mark")
    ids = ids.select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(mark, F.lit(True))
    few = ids.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    found = docs.drop("target").join(F.broadcast(ids) if few else ids, F.col(f"`{doc_id}`") == F.col(key), "left")
    return found.withColumn("target", F.col(mark).isNotNull()).drop(key, mark)
