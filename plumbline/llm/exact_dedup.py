"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Pass one counts a short fingerprint of every row's hash, (word of the filter, bits within the word), and sets
the bits of those that occur at least twice in a filter of fixed size. Pass two probes the filter: a row whose bits
are not all set has a hash that nobody shares, so it goes straight through without a shuffle. Only the other rows
are grouped by their full hash, where false positives of the filter turn out as groups of one.

The filter holds at most `FILTER_WORDS` words of 64 bits at any input size, which is what makes its broadcast safe;
when far more hashes repeat than it has bits for, more rows are grouped, and the result stays exact.

Hot groups: groups are counted with map-side aggregation first. The few with more than 1/`HOT_SHARE` of the candidate
rows (so fewer than `HOT_SHARE` of them) reach their rows by broadcast, all others by a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.tables import free, text_or_empty, written

FILTER_WORDS = 1 << 18
HOT_SHARE = 2000
WHITE = r"[\x20\x09-\x0D]+"


def normalised(column: str) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), WHITE, " ")


def text_hash(column: str) -> Column:
    """SHA-256 of the normalised text's UTF-8 bytes, 32 bytes."""
    return F.unhex(F.sha2(normalised(column), 256))


def _word(h: Column) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(FILTER_WORDS)).cast("int")


def _bits(h: Column) -> Column:
    """Four of the 64 bits of a word, from a second hash."""
    second = F.xxhash64(h, F.lit("bits"))
    out = F.lit(0).cast("long")
    for k in range(4):
        position = F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), position))
    return out


def repeat_filter(hashes: DataFrame, column: str) -> DataFrame:
    """Pass one: the Bloom filter of hashes that possibly occur twice, as rows (word, bits); at most FILTER_WORDS rows."""
    h = F.col(column)
    shared = (
        hashes.where(h.isNotNull()).groupBy(_word(h).alias("word"), _bits(h).alias("bits"))
        .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    return shared.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def probe(df: DataFrame, bloom: DataFrame, column: str, flag: str) -> DataFrame:
    """Pass two: adds `flag`, false where the row's hash certainly occurs once; no shuffle of `df`."""
    word, bits = free(df, "bloom_word"), free(df, "bloom_bits")
    small = F.broadcast(bloom.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    h = F.col(column)
    hit = F.coalesce(F.col(bits).bitwiseAND(_bits(h)) == _bits(h), F.lit(False))
    return df.withColumn(word, _word(h)).join(small, word, "left").withColumn(flag, hit).drop(word, bits)


def repeat_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and empty texts are equal to each other. Among equal texts the smallest doc_id
    stays; a null id loses to every other. Rows that repeat an id and its text are each a member of the group, and
    exactly one of them is kept. An empty table gives an empty result. Other columns are not carried.
    """
    ids = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), text_hash(text).alias("h"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(ids, "hashes")
    probed = probe(rows, repeat_filter(rows, "h"), "h", "shared")
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("h")).alias("text_sha256")]
    single = probed.where(~F.col("shared")).select(
        "*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
    )
    candidates = written(probed.where("shared").drop("shared"), "candidates")
    # nulls sort last through the leading flag; the row number settles repeated ids
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    groups = candidates.groupBy("h").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    groups = written(groups, "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > total))
    cold = groups.where(F.col("group_size") * HOT_SHARE <= total)
    grouped = candidates.join(hot, "h").unionByName(
        candidates.join(F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > total).select("h")), "h", "left_anti")
        .join(cold, "h")
    )
    grouped = grouped.withColumns({"keep_id": F.col("first.doc_id"), "kept": F.col("row") == F.col("first.row")})
    return single.select(*columns).unionByName(grouped.select(*columns))


def drop_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with one row per text, all columns as they were: the rows `repeat_groups` keeps.

    Rows that no one shares a hash with are never shuffled. Of the candidates one row per hash stays: smallest doc_id,
    nulls last, then the smallest hash of the whole row (rows equal in every column are interchangeable).
    """
    h, flag, rank = free(docs, "sha"), free(docs, "shared"), free(docs, "rank")
    hashed = docs.withColumn(h, text_hash(text))
    bloom = written(repeat_filter(hashed.select(F.col(h).alias("h")), "h"), "filter")
    probed = probe(hashed, bloom, h, flag)
    order = Window.partitionBy(h).orderBy(
        F.col(f"`{doc_id}`").asc_nulls_last(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    )
    first = probed.where(F.col(flag)).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return probed.where(~F.col(flag)).select(*names).unionByName(first.select(*names))
