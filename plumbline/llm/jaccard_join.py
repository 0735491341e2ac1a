"""Near-duplicate texts: exact Jaccard join of word shingles with count-vector R-trees.

Method: a text is the set of hashes of its word shingles. Its count vector has one coordinate per group of hashes (hash modulo
`GROUPS`). Two sets share at most the sum of the coordinates' minima, and a node of an R-tree over such points bounds
all its points at once by the sum of minima with the node's upper corner.

1. Equal sets become one class; classes are told apart by set size and a 64-bit signature.
2. Cells. Hashes have a global order: first those in buckets of ordinary load (counted over the whole corpus), by hash,
   then those in heavier buckets, the heaviest last. Sets that link share a hash among their first |x| - ceil(t|x|) + 1,
   so a class is in the cells of these hashes, and no link is outside a cell. Cells of one class are dropped.
3. First wave: each class is compared with one other, the one that is the smallest signature in most of its cells. In
   a group of near copies that is nearly always the same one, so one comparison per member joins most of the group.
4. Second wave: cells that still hold several components are searched, small ones pair by pair, larger ones by an
   R-tree over their members' count vectors, and per member and other component the most promising pair is compared.
   Third wave: all pairs of different components that the bounds leave. So every pair that may link is either verified
   or connects classes that are connected already.

All candidates pass the bound of their count vectors first, and then that of parity bitmaps, which are as long as the sets
and so tell long texts apart that 256 coordinates do not. Those that remain are verified on the hash sets themselves,
which are derived again from the texts for just these classes, from one text of each (a Bloom filter of fixed size picks
the texts by a hash of the whole text before any word is read; texts are never shuffled). Cells of more than `TILE` members are dealt into parts, and pairs of parts are compared in groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.batches import WordHasher, mixed, text_pieces
from plumbline.llm.groups import attach, components
from plumbline.llm.tables import free, text_or_empty, written

WORDS = 5
PERCENT = 80
GROUPS = 256
BUCKETS = 1 << 16
BLOCKS = 64
SPLIT_CELL = 20_000
TILE = 1024
LEAF = 16
FILTER_BITS = 18
_STEP = np.uint64(0xD1342543DE82EF95)


def shingles(words: np.ndarray, first: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of all texts, given word hashes and each text's first word (with the total at the end)."""
    counts = np.diff(first)
    of = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    out_of, out = [], []
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = mixed(h * _STEP + words[k : n - width + 1 + k])
        whole = of[: n - width + 1] == of[width - 1 :]
        out_of.append(of[: n - width + 1][whole])
        out.append(h[whole])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):  # the whole sequence is the one shingle; its length goes in, so that it equals no other kind
        h = counts[short].astype(np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            w = words[np.minimum(first[short] + k, n - 1)]
            h = np.where(has, mixed(h * _STEP + w), h)
        out_of.append(short)
        out.append(mixed(h + np.uint64(1)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_of), np.concatenate(out)


def _sets(column: pa.Array, hasher: WordHasher, rank: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from row, to row, starts of the sets, hashes, signatures) per piece of a text column; the hashes of a set are
    distinct and in order of (rank of the bucket, hash)."""
    for a, b, data, edges in text_pieces(column):
        of, h = shingles(*hasher(data, edges))
        if (of[1:] < of[:-1]).any():  # the short texts come last
            order = np.argsort(of, kind="stable")
            of, h = of[order], h[order]
        ends = np.searchsorted(of, np.arange(b - a + 1)).tolist()
        for i, j in zip(ends[:-1], ends[1:]):  # text by text in place: far quicker than one sort by two keys
            h[i:j].sort()
        new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
        of, h = of[new], h[new]
        if rank is not None and (ranks := rank[_bucket(h)]).any():
            h = h[np.argsort(of * (rank.max() + 1) + ranks, kind="stable")]
        starts = np.searchsorted(of, np.arange(b - a + 1))
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mixed(h ^ _STEP), out=sums[1:])
        yield a, b, starts, h, mixed(sums[starts[1:]] - sums[starts[:-1]])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def least_overlap(n, m, percent: int = PERCENT):
    """The smallest intersection with which sets of n and m hashes link."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


class CountTree:
    """An R-tree over count vectors: leaves of `LEAF` points in order of size and of their heaviest coordinates, nodes of
    `LEAF` children, each with the upper corner of its points and the range of their sizes and components."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        spread = np.argsort(-points.var(axis=0), kind="stable")[:3]
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * LEAF)
        self.order = np.lexsort((*points[:, spread].T, slab))
        top, n, c = points[self.order], sizes[self.order], comps[self.order]
        self.levels = [(top, n, n, c, c)]
        while len(top) > LEAF:
            cut = np.arange(0, len(top), LEAF)
            _, low, high, first, last = self.levels[-1]
            top = np.maximum.reduceat(top, cut)
            self.levels.append((top, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)))

    def search(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, bound) of all points of other components that the bounds do not rule out."""
        q = np.repeat(np.arange(len(points)), len(self.levels[-1][0]))
        at = np.tile(np.arange(len(self.levels[-1][0])), len(points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, first, last = self.levels[depth]
            n = sizes[q]
            near = (100 * high[at] >= percent * n) & (percent * low[at] <= 100 * n) & ~((first[at] == comps[q]) & (last[at] == comps[q]))
            q, at = q[near], at[near]
            bound = np.concatenate([np.minimum(points[q[i : i + 4096]], top[at[i : i + 4096]]).sum(axis=1, dtype=np.int64) for i in range(0, len(q), 4096)] or [np.zeros(0, np.int64)])
            # a smaller partner needs less overlap, but none links that is smaller than the size limit
            least = least_overlap(sizes[q], np.maximum(low[at], (percent * sizes[q] + 99) // 100), percent)
            some = bound >= least
            q, at, bound = q[some], at[some], bound[some]
            if depth:
                width = np.minimum(LEAF, len(self.levels[depth - 1][0]) - at * LEAF)
                child = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                q, at = np.repeat(q, width), np.repeat(at * LEAF, width) + child
        return q, self.order[at], bound


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(v.as_buffer(), "<u2" if len(v.as_buffer()) > GROUPS else "u1") for v in column], np.int32).reshape(-1, GROUPS)


def _vector(hashes: np.ndarray) -> bytes:
    """Counts by group, one byte each where all fit."""
    counts = np.bincount((hashes % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    if counts.max(initial=0) > 65_535:
        counts[:] = 65_535  # beyond 16 bits, a bound that rules nothing out
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u2").tobytes()


def _parity(hashes: np.ndarray) -> bytes:
    """The set's size, and a bitmap of at least as many bits: a bit per group of hashes, set where their number is odd.

    Every bit in which two sets differ is a hash that only one of them has. The bitmap is XOR-folded to half its length by
    taking one bit less of the hashes, so those of different lengths can be compared.
    """
    size = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.array([len(hashes)], "<i8").tobytes() + np.packbits(odd.astype(bool)).tobytes()


def _overlap_bound(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """(sizes of both sets, what their intersection can have at most), by their parities."""
    n, m = int(x[:8].view("<i8")[0]), int(y[:8].view("<i8")[0])
    x, y = x[8:], y[8:]
    while len(x) != len(y):
        long, y = (x, y) if len(x) > len(y) else (y, x)
        x = long[: len(long) // 2] ^ long[len(long) // 2 :]
    return n, m, (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def _signatures(rows: DataFrame) -> DataFrame:
    """Rows (kind 0: doc_id, text_key, n, sig; kind 1: block number as n, counts of hash buckets) of (doc_id, text_key, text)."""
    names = ["kind", "doc_id", "text_key", "n", "sig", "counts"]

    def run(batches):
        hasher, load = WordHasher(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            size = batch.num_rows
            n, sig = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for a, b, starts, h, s in _sets(batch.column(2), hasher):
                n[a:b], sig[a:b] = np.diff(starts), s.view(np.int64)
                load += np.bincount(_bucket(h), minlength=BUCKETS)
            columns = [pa.array(np.zeros(size, np.int32)), batch.column(0), batch.column(1), pa.array(n), pa.array(sig), pa.nulls(size, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        parts = load.astype("<i8").reshape(BLOCKS, -1)
        none = pa.nulls(BLOCKS, pa.int64())
        counts = pa.array([p.tobytes() for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(BLOCKS, np.int32)), none, none, pa.array(np.arange(BLOCKS)), none, counts], names=names)

    return rows.mapInArrow(run, "kind int, doc_id long, text_key long, n long, sig long, counts binary")


def _bucket_loads(signed: DataFrame) -> np.ndarray:
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_buffer(), "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["n", "counts"])

    out = np.zeros((BLOCKS, BUCKETS // BLOCKS), np.int64)
    for r in signed.where("kind = 1").select("n", "counts").repartition("n").mapInArrow(add, "n long, counts binary").collect():  # BLOCKS rows
        out[r.n] = np.frombuffer(r.counts, "<i8")
    return out.ravel()


def _postings(texts: DataFrame, load: np.ndarray, percent: int) -> DataFrame:
    """Rows (hash, sig, n, salt): the cells of every class; each task names a class once."""
    usual = np.median(load)
    heavy = load > usual + 8 * np.sqrt(usual) + 8
    rank = np.where(heavy, 1 + np.floor(4 * np.log2(np.maximum(load, 1) / max(usual, 1))), 0).astype(np.int64)
    salts = np.where(heavy, np.ceil((load - usual) / SPLIT_CELL), 1).astype(np.int64)  # by what is more than usual
    shared = texts.sparkSession.sparkContext.broadcast((rank, salts))

    def run(batches):
        hasher, seen = WordHasher(), set()
        rank, salts = shared.value
        for batch in batches:
            for _, _, starts, h, sig in _sets(batch.column(0), hasher, rank):
                n = np.diff(starts)
                new = np.array([x > 0 and (s, x) not in seen and not seen.add((s, x)) for s, x in zip(sig.tolist(), n.tolist())], bool)
                size = np.where(new, prefix(n, percent), 0)
                inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                token = h[np.repeat(starts[:-1], size) + inner]
                own = np.repeat(sig, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(own.view(np.int64)), pa.array(np.repeat(n, size).astype(np.int32)),
                     pa.array((own % salts[_bucket(token)].astype(np.uint64)).astype(np.int32)), pa.array(salts[_bucket(token)] > 1)],
                    names=names,
                )
                if len(seen) > 2_000_000:  # forgetting repeats some rows, which the cells drop
                    seen.clear()

    names = ["token", "sig", "n", "salt", "split"]
    return texts.mapInArrow(run, "token long, sig long, n int, salt int, split boolean")


def _shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (token, salt, sig, n), those of cells with several classes, without repeats. A run that goes
    on in the next batch is known by its last row, which is held back."""
    held: pa.Table | None = None
    names = ["token", "sig", "n"]
    last_key, last_out = None, False

    def flush(t, final):
        nonlocal last_key, last_out
        token, salt, sig, n, split = (t.column(c).to_numpy() for c in ("token", "salt", "sig", "n", "split"))
        repeat = np.r_[False, (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (sig[1:] == sig[:-1]) & (n[1:] == n[:-1])]
        token, salt, sig, n, split = (x[~repeat] for x in (token, salt, sig, n, split))
        same = np.r_[False, (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])]
        if last_key is not None and len(token) and (token[0], salt[0]) == last_key:
            same[0] = True
        many = split | same | np.r_[same[1:], False]
        keep = many.copy()
        stop = len(token) if final else len(token) - 1  # the last row's run may go on
        keep[stop:] = False
        if stop:
            last_key = (token[stop - 1], salt[stop - 1])
        out = pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, sig, n)], names=names)
        rest = None if final or not len(token) else pa.table({"token": token[stop:], "salt": salt[stop:], "sig": sig[stop:], "n": n[stop:], "split": split[stop:]})
        return out, rest

    for batch in batches:
        t = pa.Table.from_batches([batch]).select(["token", "salt", "sig", "n", "split"])
        held = pa.concat_tables([held, t.cast(held.schema)]) if held is not None else t
        if held.num_rows > 1:
            out, held = flush(held, False)
            yield out
    if held is not None:
        out, _ = flush(held, True)
        yield out


def _filter(classes: DataFrame) -> np.ndarray:
    """A Bloom filter of the classes' text keys: 2^`FILTER_BITS` words, whatever their number."""
    s = F.col("text_key")
    bits = F.lit(0).cast("long")
    for k in range(3):
        at = F.shiftrightunsigned(s, FILTER_BITS + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    words = classes.groupBy(s.bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("word")).agg(F.bit_or(bits).alias("bits"))
    out = np.zeros(1 << FILTER_BITS, np.uint64)
    filled = words.toArrow()  # at most as many rows as the filter has words: as Row objects they would take 30 times the memory
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return out


def _may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which text keys the Bloom filter does not rule out."""
    bits = np.zeros(len(keys), np.uint64)
    for k in range(3):
        bits |= np.uint64(1) << (keys >> np.uint64(FILTER_BITS + 6 * k) & np.uint64(63))
    return words[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] & bits == bits


def _derived(texts: DataFrame, classes: DataFrame, vectors: bool) -> DataFrame:
    """(sig, n, data, parity) of the classes (sig, n, text_key): their count vectors or their hash sets, one row each; parities
    with the vectors only. Only texts whose key the classes may hold are gone through."""
    shared = texts.sparkSession.sparkContext.broadcast(_filter(classes))

    def run(batches):
        hasher, seen, words = WordHasher(), set(), shared.value
        for batch in batches:
            asked = pa.array(_may_hold(words, batch.column(0).to_numpy().view(np.uint64)), pa.bool_())
            for _, _, starts, h, sig in _sets(batch.column(1).filter(asked), hasher):
                n = np.diff(starts)
                hit = [i for i in np.flatnonzero(n).tolist() if (sig[i], n[i]) not in seen and not seen.add((sig[i], n[i]))]
                parts = [h[starts[i] : starts[i + 1]] for i in hit]
                data = [_vector(p) if vectors else p.astype("<u8").tobytes() for p in parts]
                parity = [_parity(p) if vectors else None for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[hit].view(np.int64)), pa.array(n[hit].astype(np.int32)), pa.array(data, pa.binary()), pa.array(parity, pa.binary())],
                    names=["sig", "n", "data", "parity"],
                )
                if len(seen) > 2_000_000:
                    seen.clear()

    found = texts.mapInArrow(run, "sig long, n int, data binary, parity binary").join(classes.select("sig", "n"), ["sig", "n"], "left_semi")
    out = written(found.dropDuplicates(["sig", "n"]), "derived")
    shared.destroy()
    return out


def _both_sides(pairs: DataFrame, derived: DataFrame, data: str = "data") -> DataFrame:
    side = lambda key, name: derived.select(F.col("sig").alias(key), F.col(data).alias(name))
    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select(*pairs.columns, "x", "y")


def _bounded(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose count vectors do not rule a link out, with `bound`."""
    names = [*pairs.columns, "bound"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = _vectors(part.column("x")), _vectors(part.column("y"))
                bound = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                keep = bound >= least_overlap(x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64), percent)
                keep |= (x == 65_535).all(axis=1) | (y == 65_535).all(axis=1)
                part = pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), pa.array(bound)], names=names)
                yield part.filter(pa.array(keep, pa.bool_()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return _both_sides(pairs, vectors).mapInArrow(run, f"{fields}, bound long")


def _near(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities do not rule a link out."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                n, m, most = _overlap_bound(np.frombuffer(x.as_buffer(), "u1"), np.frombuffer(y.as_buffer(), "u1"))
                keep.append(most >= least_overlap(n, m, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both_sides(pairs.select("a", "b"), vectors, "parity").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, members: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their hash sets. Sets are long and move once per pair, so only those of
    pairs that their parities leave do."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                keep.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()) >= least_overlap(len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(_near(pairs, vectors, percent), "near")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    sets = _derived(texts, members.join(asked, "sig", "left_semi"), vectors=False)
    return written(_both_sides(pairs, sets).mapInArrow(run, "a long, b long"), "links")


def _leaf_pairs(percent: int):
    """Pairs of different components and fitting sizes in runs of equal token, each run of at most `LEAF` rows."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            token = held.column("token").to_numpy()
            stop = int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last run may go on
            yield from pairs(held.slice(0, stop))
            held = held.slice(stop)
        if held is not None:
            yield from pairs(held)

    def pairs(t):
        token, sig, n, comp = (t.column(c).to_numpy() for c in ("token", "sig", "n", "comp"))
        n = n.astype(np.int64)
        for d in range(1, LEAF):
            i = np.flatnonzero(token[d:] == token[:-d]) if len(token) > d else np.zeros(0, np.int64)
            if not len(i):
                return
            j = i + d
            fits = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[fits], j[fits]
            swap = sig[i] > sig[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig[i], sig[j])], names=["a", "b"])

    return run


def _search_cells(best: bool, percent: int):
    """Candidate pairs of one tile of a cell: its asking members against an R-tree of its other ones."""

    def run(key, table):
        sig, n, comp, asks = (table.column(c).to_numpy() for c in ("sig", "n", "comp", "asks"))
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(left) or not len(right):
            return empty
        points, n = _vectors(table.column("vec")), n.astype(np.int64)
        q, at, bound = CountTree(points[right], n[right], comp[right]).search(points[left], n[left], comp[left], percent)
        a, b = left[q], right[at]
        if best and len(a):  # the pair of largest bound for each (asking member, component)
            order = np.lexsort((-bound, comp[b], sig[a]))
            a, b, bound = a[order], b[order], bound[order]
            first = np.r_[True, (sig[a][1:] != sig[a][:-1]) | (comp[b][1:] != comp[b][:-1])]
            a, b, bound = a[first], b[first], bound[first]
        return pa.table({"a": np.minimum(sig[a], sig[b]), "b": np.maximum(sig[a], sig[b]), "bound": bound}, empty.schema)

    empty = pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "bound")})
    return run


def _cell_pairs(
    cells: DataFrame, vectors: DataFrame, joined: DataFrame, tried: DataFrame, left: DataFrame | None, percent: int
) -> tuple[DataFrame, DataFrame]:
    """(pairs to compare now, pairs of small cells that the bounds leave), from the cells that hold several components.

    Without `left`, the second wave: all cells are searched and the best pairs chosen. With it, the third: small cells
    have no other pairs than those that were left then, larger ones are searched again for all pairs.
    """
    best = left is None
    component = joined.select(F.col("node").alias("sig"), F.col("component").alias("comp"))
    now = cells.join(component, "sig", "left").select("token", "sig", "n", F.coalesce("comp", "sig").alias("comp"))
    now = written(now, "members")
    open_ = now.groupBy("token").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.count(F.lit(1)).alias("size")).where("c < d")
    open_ = written(open_.select("token", "size", F.ceil(F.col("size") / TILE).cast("int").alias("parts")), "open")

    if best:
        small = now.join(open_.where(F.col("size") <= LEAF).select("token"), "token").repartition("token").sortWithinPartitions("token")
        found = small.mapInArrow(_leaf_pairs(percent), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        left = written(_bounded(found, vectors, percent).select("a", "b", "bound"), "left")
    ends = [component.select(F.col("sig").alias(k), F.col("comp").alias(f"{k}_comp")) for k in ("a", "b")]
    found = left.join(tried, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    found = found.where(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b", "bound")

    # in larger cells, members outside the largest component ask all members: a group of near copies that holds a cell
    # but for a few is gone through once per few, not once per pair
    large = open_.where(F.col("size") > LEAF)
    counts = now.join(large.select("token"), "token").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), (F.sum("k") - F.max("k")).alias("others"))
    main = main.withColumn("ask_parts", F.ceil(F.col("others") / TILE).cast("int"))
    large = written(large.join(main, "token"), "large")
    rows = attach(now, large, ["token"], "size").join(vectors.select("sig", F.col("data").alias("vec")), "sig")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    part = lambda parts: F.pmod(F.xxhash64("sig"), F.col(parts)).cast("int")
    fields = ["token", "i", "j", "sig", "n", "comp", "vec"]
    asking = rows.where("comp <> main").withColumn("i", part("ask_parts")).withColumn("j", upto("parts"))
    asked = rows.withColumn("j", part("parts")).withColumn("i", upto("ask_parts"))
    tiles = asking.select(*fields, F.lit(True).alias("asks")).unionByName(asked.select(*fields, F.lit(False).alias("asks")))
    searched = tiles.groupBy("token", "i", "j").applyInArrow(_search_cells(best, percent), "a long, b long, bound long")
    found = found.unionByName(searched.distinct().join(tried, ["a", "b"], "left_anti"))
    if best:
        other = component.select(F.col("sig").alias("b"), F.col("comp").alias("with"))
        chosen = found.join(other, "b", "left").groupBy("a", F.coalesce("with", "b").alias("with"))
        found = chosen.agg(F.max(F.struct("bound", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    return written(found.select("a", "b").distinct(), "pairs"), left


def _grouped(docs: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """One row per input row: doc_id, text_key (hash of the text), n_shingles, component_id."""
    body = text_or_empty(text)
    signed = written(_signatures(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("text"))), "signatures")
    rows = signed.where("kind = 0").select("doc_id", "text_key", "n", "sig")
    full = rows.where("n > 0")
    texts = docs.select(F.xxhash64(body).alias("text_key"), body.alias("text"))
    posted = _postings(texts.select("text"), _bucket_loads(signed), percent).repartition("token", "salt").sortWithinPartitions("token", "salt", "sig", "n")
    cells = written(posted.mapInArrow(_shared_cells, "token long, sig long, n int"), "cells")
    first_texts = full.groupBy("sig", F.col("n").cast("int").alias("n")).agg(F.min("text_key").alias("text_key"))
    members = written(first_texts.join(cells.select("sig", "n").distinct(), ["sig", "n"], "left_semi"), "classes")
    vectors = _derived(texts, members, vectors=True)

    firsts = cells.groupBy("token").agg(F.min("sig").alias("first"), F.count(F.lit(1)).alias("size"))
    met = attach(cells, written(firsts, "firsts"), ["token"], "size").where("first < sig")
    often = met.groupBy(F.col("sig").alias("b"), F.col("first").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    tried = written(often.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "pairs")
    pairs = written(_bounded(tried, vectors, percent), "pairs")
    links = _verified(pairs, texts, members, vectors, percent)
    joined = components(links)
    left = None
    for _ in range(2):
        pairs, left = _cell_pairs(cells, vectors, joined, tried, left, percent)
        if pairs.isEmpty():
            continue  # the next wave asks for the pairs that this one set aside
        tried = written(tried.unionByName(pairs), "tried")
        new = _verified(pairs, texts, members, vectors, percent)
        if not new.isEmpty():
            links = links.unionByName(new)
            joined = components(links)
    linked = joined.select(F.col("node").alias("sig"), "component")
    classes = full.groupBy("sig", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    classes = written(classes.join(linked, "sig", "left").withColumn("component", F.coalesce("component", "sig")), "classes")
    names = written(classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "names")
    named = written(attach(classes, names, ["component"], "members").select("sig", "n", "size", "component_id"), "named")
    out = attach(full, named, ["sig", "n"], "size").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space with A-Z in lower case; a text of fewer than five words has its
    whole sequence as one shingle. A null text, or one without words, has an empty set and links with nothing, not
    even its like. Repeated rows link with each other. component_id is the smallest doc_id reachable; null ids never
    name a component, and one of null ids alone has null. An empty table gives an empty result. Only doc_id and text
    are read. Two sets of one size are taken for equal by their 64-bit signatures.
    """
    return _grouped(docs, text, doc_id, percent).drop("text_key")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """`docs` with one row of each group of near duplicates, that of the smallest id; columns as they were.

    Rows without words all stay. A row with a null id goes if its group has a row with an id, otherwise it stays. Of
    rows that repeat both id and text in a group of several, one stays.
    """
    found = _grouped(docs, text, doc_id, percent)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    verdict = found.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.min(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    verdict = written(verdict.where(~F.col("stays") | (F.col("n") > 1)), "verdicts")
    key, stay, judged_id, judged_key = (free(docs, c) for c in ("text_key", "stays", "judged_id", "judged_key"))
    verdict = verdict.select(F.col("doc_id").alias(judged_id), F.col("text_key").alias(judged_key), F.col("stays").alias(stay))
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.xxhash64(text_or_empty(text)))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(judged_id)) & (F.col(key) == F.col(judged_key))
    judged = keyed.join(verdict, same, "left")
    once = judged.where(F.col(stay)).dropDuplicates([doc_id, key])
    return judged.where(F.col(stay).isNull()).select(*names).unionByName(once.select(*names))
