"""Phrase collocations from a weighted de Bruijn graph of the longest grams.

Nodes are runs of m - 1 words, edges the runs of m words between overlapping nodes, weighted by how often they occur
(m = `longest`). The text is counted once, at the longest length only: every word position gives the run of m words
that starts there or, where its piece ends before, the shorter rest of the piece. All shorter counts follow from these:
a run of k < m words occurs as often as edges flow out of it, plus the piece-end corrections, that is the rests of at
least k words that begin with it.

1. Pairs of neighbouring words are counted by 64-bit hash. Hashes below the threshold hold no frequent pair (a shared
   hash only counts too much), so no phrase crosses them: pieces may end there, which keeps most of the text's chance
   runs out of the shuffle and changes no frequent count. The frequent hashes become a bitmap of at most `BITMAP` bits;
   a bit set by chance costs time and changes nothing.
2. Edges and rests are counted as text, exactly, by language.
3. Unary paths of the frequent edges' graph are compacted: at a node with one way in and one way out both edges
   become one row. Rounds join disjoint pairs of neighbouring paths, chosen by hash, so long repeated passages shrink
   to a few rows, and what a passage contains leaves it once instead of once per edge.
4. Candidates get the counts of their parts and of the longer phrases around them by joins on the phrases; only
   frequent phrases take part.

Everything is grouped by whole phrases, with partial sums before each shuffle; no key gathers rows by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.batches import LOWER, mixed, span_hashes, text_pieces, word_spans
from plumbline.llm.tables import text_or_empty, written

LONGEST = 4
LEAST = 30
COVERED = 80
TOP = 2000
UNKNOWN_LANGUAGE = "und"
BITMAP = 1 << 27
BITS_PER_PAIR = 32
HELD_PAIRS = 1 << 21
ROUNDS = 4
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, starts, ends, text of each word, whether the next word stands in the same piece)."""
    starts, ends = word_spans(~_GAP[data], edges)
    text = np.searchsorted(edges, starts, "right") - 1
    piece = np.concatenate([[0], np.cumsum(_BREAK[data])])[starts]
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return LOWER[data], starts, ends, text, joined


def _pair_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Hashes of the pairs that begin at the words `at`, of the given languages."""
    h = span_hashes(data, starts, ends)
    return mixed((h[at] ^ language) * np.uint64(0xD1342543DE82EF95) + h[at + 1])


def frequent_pairs(rows: DataFrame, least: int) -> np.ndarray:
    """A bitmap (64-bit words, a power of two) in which the hashes of all pairs that occur `least` times are set."""

    def count(batches):
        held, n = [], 0

        def summed():
            h, c = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.add.reduceat(c, first))], names=["h", "n"])

        for batch in batches:
            languages = batch.column(2).to_numpy().view(np.uint64)
            for a, b, data, edges in text_pieces(batch.column(0)):
                data, starts, ends, text, joined = _words(data, edges)
                at = np.flatnonzero(joined)
                if len(at):
                    held.append(np.unique(_pair_hashes(data, starts, ends, at, languages[a:b][text[at]]), return_counts=True))
                    n += len(held[-1][0])
                if n > HELD_PAIRS:  # memory stays bounded, Spark adds up the rest
                    yield summed()
                    held, n = [], 0
        if held:
            yield summed()

    pairs = rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = written(pairs.select("h"), "pairs")
    bits = min(BITMAP, 1 << max(12, (BITS_PER_PAIR * pairs.count()).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    words = pairs.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & {63} as int))")).alias("bits"))
    out = np.zeros(bits >> 6, np.uint64)
    found = words.toArrow()  # at most BITMAP / 64 numbers, whatever the input
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, gram, n): runs of `longest` words and shorter rests, one for every word of every text, counted."""
    language = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang")
    rows = docs.select(text_or_empty(text).alias("text"), language)
    rows = rows.select("text", "lang", F.xxhash64("lang").alias("seed"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pairs(rows, least))

    def grams(batches):
        bitmap = shared.value
        mask = np.uint64(64 * len(bitmap) - 1)
        for batch in batches:
            languages = batch.column(2).to_numpy().view(np.uint64)
            for a, b, data, edges in text_pieces(batch.column(0)):
                data, starts, ends, text, joined = _words(data, edges)
                if not len(starts):
                    continue
                at = np.flatnonzero(joined)
                bit = _pair_hashes(data, starts, ends, at, languages[a:b][text[at]]) & mask
                joined[at] = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                run, length = joined, np.ones(len(starts), np.int64)
                for _ in range(longest - 1):
                    length += run
                    run = joined & np.concatenate([run[1:], [False]])
                # words with one space after each, of which every gram is a slice
                size = ends - starts + 1
                to = np.cumsum(size)
                begin = to - size
                spaced = np.concatenate([data, [32]]).astype(np.uint8)[np.repeat(starts - begin, size) + np.arange(to[-1])]
                spaced[to - 1] = 32
                stop = to[np.arange(len(starts)) + length - 1] - 1
                width = stop - begin
                offsets = np.concatenate([[0], np.cumsum(width)])
                body = spaced[np.repeat(begin - offsets[:-1], width) + np.arange(offsets[-1])]
                gram = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(text + a)), gram], names=["lang", "gram"])

    return rows.mapInArrow(grams, "lang string, gram string").groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))


def n_words(gram: Column) -> Column:
    return F.length(gram) - F.length(F.replace(gram, F.lit(" "), F.lit(""))) + 1


def flows(grams: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, f): all phrases of k = 1 to `longest` words that occur f >= `least` times, from node flow and rests."""
    prefixes = F.expr("transform(sequence(1, length(gram) - length(replace(gram, ' ', '')) + 1), k -> substring_index(gram, ' ', k))")
    every = grams.select("lang", F.explode(prefixes).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return every.where(F.col("f") >= least).select("lang", "phrase", n_words(F.col("phrase")).cast("int").alias("k"), "f")


def compact(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(lang, phrase, f) of edges, all of one number of words, to paths (lang, words, weights): weights[i] is the f of the
    edge that starts at words[i]. Every edge is in one path; an edge between two nodes that are not unary is its own."""
    m = F.col("k")
    rows = edges.select("lang", F.split("phrase", " ").alias("words"), F.array("f").alias("weights"))
    rows = rows.withColumn("k", F.size("words"))
    node = lambda start: F.array_join(F.slice("words", start, m - 1), " ")
    rows = rows.withColumns({"head": node(F.lit(1)), "tail": node(F.size("words") - m + 2), "edge": F.array_join("words", " ")})
    ends = F.explode(F.array(F.struct(F.col("head").alias("node"), F.lit(1).alias("out")), F.struct(F.col("tail").alias("node"), F.lit(0).alias("out"))))
    degrees = rows.select("lang", ends.alias("e")).groupBy("lang", "e.node").agg(F.sum("e.out").alias("out"), F.count(F.lit(1)).alias("all"))
    unary = degrees.where("out = 1 AND all = 2").select("lang", "node", F.lit(True).alias("unary"))
    for end in ("head", "tail"):
        named = unary.select("lang", F.col("node").alias(end), F.col("unary").alias(f"{end}_open"))
        rows = rows.join(named, ["lang", end], "left").withColumn(f"{end}_open", F.coalesce(f"{end}_open", F.lit(False)))
    part = F.struct("words", "weights", "head", "tail", "head_open", "tail_open", "k", "edge")
    for r in range(rounds):
        order = lambda c: F.xxhash64(F.lit(r), c)  # noqa: B023, E731
        loop = F.col("head") == F.col("tail")
        at_tail = F.col("tail_open") & ~loop & (~F.col("head_open") | (order("tail") < order("head")))
        at_head = F.col("head_open") & ~loop & ~at_tail
        # a path that meets nobody keeps its first edge as key, which has one word more than a node
        keyed = rows.withColumns({"at": F.when(at_tail, F.col("tail")).when(at_head, F.col("head")).otherwise(F.col("edge")), "p": part, "left": ~at_head})
        both = keyed.groupBy("lang", "at").agg(F.max(F.when(F.col("left"), F.col("p"))).alias("a"), F.max(F.when(~F.col("left"), F.col("p"))).alias("b"))
        a, b = F.col("a"), F.col("b")
        rest = F.slice(b["words"], b["k"], F.size(b["words"]) - b["k"] + 1)
        merged = F.struct(
            F.concat(a["words"], rest).alias("words"), F.concat(a["weights"], b["weights"]).alias("weights"), a["head"].alias("head"), b["tail"].alias("tail"),
            a["head_open"].alias("head_open"), b["tail_open"].alias("tail_open"), a["k"].alias("k"), a["edge"].alias("edge"),
        )
        rows = both.select("lang", F.when(b.isNull(), a).when(a.isNull(), b).otherwise(merged).alias("p")).select("lang", "p.*")
    return rows.select("lang", "words", "weights")


def contained(paths: DataFrame) -> DataFrame:
    """(lang, phrase, f): the shorter phrases of two words or more in a path, with the largest weight of an edge around each."""
    m = "(size(words) - size(weights) + 1)"
    at = f"greatest(p + j - {m}, 0)"
    inner = f"transform(sequence(0, size(words) - j), p -> struct(array_join(slice(words, p + 1, j), ' ') AS phrase, array_max(slice(weights, {at} + 1, least(p, size(weights) - 1) - {at} + 1)) AS f))"
    shorter = F.expr(f"CASE WHEN {m} > 2 THEN flatten(transform(sequence(2, {m} - 1), j -> {inner})) END")
    return paths.select("lang", F.explode(shorter).alias("s")).select("lang", "s.phrase", "s.f")


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP,
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut at `.,;:!?` and line ends, and split at spaces and tabs. A phrase of 2 to `longest`
    words that occurs a >= `least` times is a candidate. Cut after some words it has parts that occur l and r times and
    the score floor(2000000 a / (l + r)); the lowest cut counts, the first of equal ones. A candidate inside a longer
    one that occurs at least `covered` percent as often is dropped. Order: score and a descending, phrase by bytes.

    Null text has no words, null language is "und" and joins it. Texts are read whole. Repeated rows count each. An
    empty table, or one without candidates, gives an empty result; other columns are not read, whatever their names.
    """
    grams = written(gram_counts(docs, text, lang, longest, least), "grams")
    counts = written(flows(grams, longest, least), "flows")
    total = grams.groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = counts.where("k >= 2").withColumnRenamed("f", "a")

    paths = written(compact(counts.where(F.col("k") == longest)), "paths")
    shorter = counts.where((F.col("k") > 2) & (F.col("k") < longest))
    single = shorter.select("lang", F.split("phrase", " ").alias("words"), F.array("f").alias("weights"))
    around = contained(paths.unionByName(single)).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    inside = wide("around") * 100 >= wide("a") * covered
    kept = candidates.join(around, ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False)))

    cuts = kept.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = ranked.join(total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")
