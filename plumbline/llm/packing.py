"""Best-fit packing by fitting length patterns to the histogram with non-negative least squares.

1. Texts become token ids once; a document longer than a sequence is cut into full pieces after a shorter first one.
2. Spark counts pieces by length: at most `SEQUENCE` numbers, whatever the size of the data. On these alone the driver
   enumerates all patterns of up to three lengths that fill a sequence exactly, fits how often to repeat each by
   non-negative least squares, rounds down to whole repeats that the histogram covers, and packs what is left by best
   fit, longest first, still on counts.
3. The result is a bounded list of patterns with repeats, i.e. for every length a list of slots. Spark numbers the
   pieces of each length (hash buckets count their rows per length, running totals over the buckets give each its first
   number, so no task sees all pieces of a length), and a piece's number looks up its slot.

Tokens are not shuffled unless whole sequences are asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.batches import map_rows
from plumbline.llm.tables import text_or_empty, written
from plumbline.llm.tokens import Encoder

SEQUENCE = 1024
END_OF_TEXT = 2
TOKENIZER = "byte_bpe_50k.json"
BUCKET_PIECES = 16_384
FIT_STEPS = 150
KEPT_PATTERNS = 8192


def _spans(tokens: int, sequence: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = (tokens - 1) % sequence + 1
    yield 0, first
    for start in range(first, tokens, sequence):
        yield start, sequence


def pieces(
    docs: DataFrame, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", sequence: int = SEQUENCE,
    end: int = END_OF_TEXT, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (bytes, 32-bit little-endian).

    A null or empty text is one piece with the end token alone. Very long texts are tokenized whole. The string of an
    added token in a text gives that token's id, as the tokenizers library does by default.
    """
    name = tokenizer or TOKENIZER

    def make():
        encode = Encoder(name)
        last = np.array([end], "<u4").tobytes()

        def one(key, body):
            ids = encode(body) + last
            for i, (start, length) in enumerate(_spans(len(ids) // 4, sequence)):
                part = ids[4 * start : 4 * (start + length)]
                yield (key, i, start, length, zlib.crc32(part)) + ((part,) if with_ids else ())

        return one

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_rows(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def fill_patterns(sequence: int) -> np.ndarray:
    """All (a, b, c) with a >= b >= c, a > 0 and sum `sequence`; 0 stands for no piece."""
    c = np.arange(sequence // 3 + 1)
    out = []
    for x in c:
        b = np.arange(max(x, 1), (sequence - x) // 2 + 1)
        out.append(np.stack([sequence - x - b, b, np.full(len(b), x)], axis=1))
    return np.concatenate(out)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 that minimise |A x - counts|, by multiplicative steps."""
    size = len(counts)
    target = counts.astype(float)
    target[0] = 0.0

    def cover(x):
        out = sum(np.bincount(patterns[:, k], x, size) for k in range(patterns.shape[1]))
        out[0] = 0.0
        return out

    x = np.where((target[patterns] > 0).all(axis=1, where=patterns > 0), 1.0, 0.0)
    goal = target[patterns].sum(axis=1)
    for _ in range(steps):
        x *= goal / np.maximum(cover(x)[patterns].sum(axis=1), 1e-12)
    return x


def best_fit(counts: np.ndarray, sequence: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: (lengths in a sequence, how many such sequences)."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(sequence + 1)]
    for length in range(sequence, 0, -1):
        left = int(counts[length])
        while left:
            fits = next((r for r in range(length, sequence) if room[r]), sequence)
            held, n = room[fits].pop() if fits < sequence else ((), -(-left // (sequence // length)))
            used = min(n, left)
            if used < n:
                room[fits].append((held, n - used))
            room[fits - length].append(((*held, length), used))
            left -= used
    return [group for groups in room for group in groups]


def plan_patterns(counts: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeats that hold every piece of the histogram `counts` (index = length) exactly once."""
    left = counts.astype(np.int64).copy()
    out = [((sequence,), int(left[sequence]))] if left[sequence] else []
    left[sequence] = 0
    if left.sum():
        patterns = fill_patterns(sequence)
        x = fit_repeats(patterns, left)
        kept = np.argsort(-x, kind="stable")[:KEPT_PATTERNS]
        kept = kept[x[kept] > 0]
        patterns = patterns[kept]
        x = np.floor(fit_repeats(patterns, left) + 1e-9).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
        for p in np.argsort(-x, kind="stable"):
            lengths = tuple(int(v) for v in patterns[p] if v)
            n = min([int(x[p]), *(int(left[v]) // lengths.count(v) for v in lengths)])
            if n:
                out.append((lengths, n))
                for v in lengths:
                    left[v] -= n
        out += best_fit(left, sequence)
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """(length, first piece number, first sequence, offset) of all slots, sorted by length and number."""
    rows, used, sequence = [], {}, 0
    for lengths, n in plan:
        offset = 0
        for v in lengths:
            rows.append((v, used.get(v, 0), sequence, offset))
            used[v] = used.get(v, 0) + n
            offset += v
        sequence += n
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack(parts: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """`parts` (from `pieces`, already written) with sequence_id and offset.

    Equal rows are pieces of their own and each get a place. An empty table gives an empty result.
    """
    histogram = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `sequence` rows
    counts = np.zeros(sequence + 1, np.int64)
    for r in histogram:
        counts[r.length] = r.n
    length, number, first, offset = slots(plan_patterns(counts, sequence)) if histogram else (np.zeros(0, np.int64),) * 4
    buckets = max(1, -(-int(counts.sum()) // BUCKET_PIECES))
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per_bucket = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    per_bucket = written(per_bucket.select("length", "bucket", running.alias("before")), "numbers")
    inner = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = keyed.withColumn("n", F.row_number().over(inner) - 1).join(per_bucket, ["bucket", "length"])
    numbered = numbered.select(*parts.columns, (F.col("before") + F.col("n")).alias("number"))
    step = 1 << 40  # beyond any number of pieces of one length
    key = length * step + number
    names = [*parts.columns, "sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            n = batch.column("number").to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() * step + n, "right") - 1
            columns = [c for c, f in zip(batch.columns, batch.schema) if f.name != "number"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first[at] + n - number[at]), pa.array(offset[at])], names=names
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, **options) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, sequence=sequence, **options), "pieces"), sequence)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of pieces that carry ids: sequence_id, ids (array), lengths (array, for attention masks)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", F.hex("ids").alias("ids"))))
    joined = packed.groupBy("sequence_id").agg(ordered.alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["ids"]), "")
    flip = lambda t: F.concat(F.substring(t, 7, 2), F.substring(t, 5, 2), F.substring(t, 3, 2), F.substring(t, 1, 2))
    ids = F.transform(F.regexp_extract_all(text, F.lit("(.{8})")), lambda t: F.conv(flip(t), 16, 10).cast("int"))
    return joined.select("sequence_id", ids.alias("ids"), F.transform("p", lambda p: p["length"]).alias("lengths"))
