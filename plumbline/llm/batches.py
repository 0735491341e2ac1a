"""Row-wise work on Arrow batches, and vectorised word hashes over a batch's text bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PIECE_ROWS = 512
PIECE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = 0x9E3779B97F4A7C15
LONG_SPAN = 256
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]], schema: str) -> DataFrame:
    """Every row through `make()(*row)`, which yields tuples of `schema`. `make` runs once per task."""
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches):
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                columns = [c.to_pylist() for c in batch.slice(at, PIECE_ROWS).columns]
                out = [row for values in zip(*columns) for row in one(*values)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow
                )

    return df.mapInArrow(run, target)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[starts[i]:ends[i]], none of them empty.

    Eight bytes at a time enter a state that begins with the length and that a bijection mixes after each; spans leave
    the loop as they end, and the few above `LONG_SPAN` bytes are hashed one by one.
    """
    n = ends - starts
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    chunk = windows[starts].view("<u8")[:, 0] & _FIRST_BYTES[np.minimum(n, 8)]
    state = mixed(chunk * np.uint64(ODD) + n.astype(np.uint64))
    open_, at = np.flatnonzero((n > 8) & (n <= LONG_SPAN)), 8
    while len(open_):
        left = n[open_] - at
        chunk = windows[starts[open_] + at].view("<u8")[:, 0] & _FIRST_BYTES[np.minimum(left, 8)]
        state[open_] = mixed((state[open_] ^ mixed(chunk)) * np.uint64(ODD) + np.uint64(at))
        open_, at = open_[left > 8], at + 8
    for i in np.flatnonzero(n > LONG_SPAN):
        state[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return state


class WordHasher:
    """64-bit hashes of the words (runs of anything but ASCII white space) of many texts at once."""

    def __call__(self, data: np.ndarray, edges: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hashes in order, index of each text's first word with the total at the end) of texts data[edges[i]:edges[i + 1]]."""
        starts, ends = word_spans(~WHITE[data], edges)
        return span_hashes(LOWER[data] if lower else data, starts, ends), np.searchsorted(starts, edges)


def word_spans(inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes that are `inside` a word; words end where texts do."""
    first = np.zeros(len(inside) + 1, bool)
    first[edges] = True
    gap = np.ones(len(inside) + 1, bool)
    gap[1:] = ~inside
    starts = np.flatnonzero(inside & (gap[:-1] | first[:-1]))
    gap[:-1] = ~inside
    gap[-1] = True
    return starts, np.flatnonzero(inside & (gap[1:] | first[1:])) + 1


def text_pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, edges of the texts in them) of a string column, about a megabyte each; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + PIECE_BYTES, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[edges[at] : edges[to]], edges[at : to + 1] - edges[at]
        at = to
