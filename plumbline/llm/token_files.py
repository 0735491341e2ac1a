"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to places in them.

A folder holds

* `ids/*.ids`: per shard a header of 16 bytes (mark, bytes per id, shard number) and then the ids of its documents, one
  after another, little-endian. Ids take 2 bytes where the vocabulary allows it and 4 elsewhere.
* `manifest` (Parquet): one row per shard: number, file, documents, ids, and the number of ids in all shards before it.
* `index` (Parquet): one row per bucket of keys: the levels of a minimal perfect hash function and, in the order of its
  values, a fingerprint of the key, shard, offset and number of ids.

A key is (doc_id, occurrence), where occurrence counts the rows of an id from 0 in file order. Its bucket comes from a
hash, so buckets hold about `BUCKET_KEYS` keys whatever the ids. In a bucket, level by level, the keys that alone hit a
bit of the level's bitmap stay there and the others go on; a key's value is the number of set bits before its own. A
lookup so tests a few bits, compares a fingerprint (a key that was never written fails it but for one in 2^32), and
knows shard and offset: no search, no list of keys.

Tasks write under names of their own, and only the rows of attempts that Spark accepts name a file, so a repeated or
lost attempt leaves at most a file that nothing refers to. The folder must be one that pyarrow's file systems open.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.batches import mixed
from plumbline.llm.tables import text_or_empty
from plumbline.llm.tokens import Encoder

TOKENIZER = "byte_bpe_50k.json"
END = 0
SHARD_DOCUMENTS = 65_536
LEAST_DOCUMENTS = 1024
BUCKET_KEYS = 16_384
CELLS_PER_KEY = 2
HEADER, HEADER_BYTES = "<4sIQ", 16
MARK = b"tids"
PLACE = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])
NULL_KEY = np.uint64(1 << 62)
BUFFER = 1 << 22


def _open(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def key_hash(ids: np.ndarray, occurrences: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of keys. Two keys that meet under one seed part under the next."""
    step = lambda k: np.uint64((2 * seed + k) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return mixed(mixed(ids.view(np.uint64) + step(1)) ^ (occurrences.view(np.uint64) * np.uint64(0xD1342543DE82EF95) + step(2)))


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0 for null) and occurrences (marked where the id is null)."""
    ids = table.column("doc_id")
    null = np.asarray(ids.is_null())
    return np.asarray(ids.fill_null(0), np.int64), np.asarray(table.column("occurrence"), np.int64).view(np.uint64) | np.where(null, NULL_KEY, np.uint64(0))


class PerfectHash:
    """A minimal perfect hash function over distinct keys: bitmaps of levels with the number of set bits before each."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        counts = [np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)]) for bits in levels]
        first = np.concatenate([[0], np.cumsum([c[-1] for c in counts])]).astype(np.int64)
        self.before = [c + f for c, f in zip(counts, first)]

    @staticmethod
    def build(ids: np.ndarray, occurrences: np.ndarray) -> PerfectHash:
        levels = []
        while len(ids):
            words = -(-max(64, CELLS_PER_KEY * len(ids)) // 64)
            at = key_hash(ids, occurrences, len(levels) + 2) % np.uint64(64 * words)
            alone = np.bincount(at.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at]
            if left.sum() == len(ids) and len(levels) > 64:
                raise ValueError("keys are not distinct")
            ids, occurrences = ids[left], occurrences[left]
        return PerfectHash(levels)

    def __call__(self, ids: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
        """Values from 0; -1 for keys that reach no level's bit (these were never written; others may get any value)."""
        out, open_ = np.full(len(ids), -1, np.int64), np.arange(len(ids))
        for k, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = key_hash(ids[open_], occurrences[open_], k + 2) % np.uint64(64 * len(bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit & np.uint64(1)).astype(bool)
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (before[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return b"".join([sizes.tobytes(), *(x.tobytes() for x in self.levels)])

    @staticmethod
    def from_bytes(data: bytes) -> PerfectHash:
        words = np.frombuffer(data, "<u8")
        ends = np.cumsum(words[1 : int(words[0]) + 1].astype(np.int64)) + int(words[0]) + 1
        return PerfectHash([words[b - n : b] for n, b in zip(words[1 : int(words[0]) + 1].astype(np.int64), ends)])


def _fingerprint(ids: np.ndarray, occurrences: np.ndarray) -> np.ndarray:
    return (key_hash(ids, occurrences, 1) >> np.uint64(32)).astype("<u4")


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "occurrence", F.lit(11)), F.lit(buckets)).cast("int"))


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id", end: int = END) -> None:
    """Tokenizes `docs` and writes shards, manifest and index to the new `folder`.

    Documents stand in ascending order of doc_id (null first; rows of one id in order of a hash of the text); each
    text's ids are followed by `end`. A null or empty text is the end id alone. Texts are tokenized whole, whatever
    their length. Repeated rows are documents of their own. Other columns are not read, whatever their names. An empty
    table gives a folder with a manifest and an index without rows.

    One shuffle orders the texts by ranges, with rows of one id or even equal rows split among ranges; after it only
    numbers move. Shards hold about `SHARD_DOCUMENTS` documents, fewer where that would leave tasks without work.
    """
    spark = docs.sparkSession
    name = tokenizer or TOKENIZER
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    total = docs.count()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-total // SHARD_DOCUMENTS), min(width, -(-total // LEAST_DOCUMENTS)))
    order = ("doc_id", "h", "row")
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    target = f"{folder}/ids"
    if "://" not in folder:
        target = target.removeprefix("file:")

    def encoded(batches):
        from pyspark import TaskContext

        encode, shard = Encoder(name), TaskContext.get().partitionId()
        kind = "<u2" if max(encode.size, end + 1) <= 1 << 16 else "<u4"
        last, width = np.array([end], kind).tobytes(), np.dtype(kind).itemsize
        offset, out, file, held, size, before, seen = 0, None, "", [], 0, ..., 0
        try:
            for batch in batches:
                at, n, occurrence = [], [], []
                for key, body in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        store, base = _open(target)
                        store.create_dir(base, recursive=True)
                        file = f"{shard:08d}-{uuid.uuid4().hex}.ids"
                        out = store.open_output_stream(f"{base}/{file}")
                        out.write(struct.pack(HEADER, MARK, width, shard))
                    ids = np.frombuffer(encode(body), "<u4").astype(kind).tobytes() + last
                    seen = seen + 1 if key == before else 0
                    before = key
                    at.append(offset)
                    n.append(len(ids) // width)
                    occurrence.append(seen)
                    offset += n[-1]
                    held.append(ids)
                    size += len(ids)
                    if size >= BUFFER:
                        out.write(b"".join(held))
                        held, size = [], 0
                k = batch.num_rows
                columns = [pa.array(x, pa.int64()) for x in (occurrence, at, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([shard] * k, pa.int32()), pa.array([file] * k)], names=names)
            if out is not None:
                out.write(b"".join(held))
        finally:
            if out is not None:
                out.close()

    names = ["doc_id", "occurrence", "offset", "n", "shard", "file"]
    schema = "doc_id long, occurrence long, offset long, n long, shard int, file string"
    path = f"{folder}/documents"
    rows.mapInArrow(encoded, schema).write.parquet(path)
    places = spark.read.schema(schema).parquet(path)

    # one row per shard; rows of an id may begin in one shard and go on in the next ones
    ends = [F.min_by("doc_id", "offset").alias("first_id"), F.max_by("doc_id", "offset").alias("last_id"), F.max_by(F.col("occurrence") + 1, "offset").alias("run")]
    per_shard = places.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("ids"), *ends)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_shard.withColumn("first", before).write.parquet(f"{folder}/manifest")
    manifest = read_manifest(spark, folder)
    earlier = manifest.select(F.col("shard").alias("s"), F.col("last_id").alias("i"), F.col("run").alias("rows"))
    goes_on = F.col("first_id").eqNullSafe(F.col("i")) & (F.col("s") < F.col("shard"))
    carried = manifest.select("shard", "first_id").join(earlier, goes_on).groupBy("shard", "first_id").agg(F.sum("rows").alias("carried"))
    same = (F.col("shard") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    keyed = places.join(carried.withColumnRenamed("shard", "s"), same, "left")
    keyed = keyed.select("doc_id", (F.col("occurrence") + F.coalesce("carried", F.lit(0))).alias("occurrence"), "shard", "offset", "n")

    def build(table: pa.Table) -> pa.Table:
        ids, occurrences = _keys(table)
        function = PerfectHash.build(ids, occurrences)
        entries = np.zeros(len(ids), PLACE)
        value = function(ids, occurrences)
        entries["fingerprint"][value] = _fingerprint(ids, occurrences)
        for field in ("shard", "offset", "n"):
            entries[field][value] = table.column(field).to_numpy()
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "function": [function.to_bytes()], "entries": [entries.tobytes()]})

    buckets = max(1, -(-total // BUCKET_KEYS))
    index = _bucketed(keyed, buckets).groupBy("bucket").applyInArrow(build, "bucket int, function binary, entries binary")
    index.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/index")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    schema = "shard int, file string, documents long, ids long, first_id long, last_id long, run long, first long"
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("bucket int, function binary, entries binary, buckets int").parquet(f"{folder}/index")


def find(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Places of keys (doc_id, occurrence): doc_id, occurrence, shard, offset, n; keys that were not written are left out.

    Each distinct key once, whatever repeats; columns besides the two are not kept. Keys and index meet by bucket.
    """
    buckets = read_index(spark, folder).agg(F.coalesce(F.max("buckets"), F.lit(1))).first()[0]
    keys = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("occurrence").cast("long").alias("occurrence")).distinct()

    def look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
        ids, occurrences = _keys(asked)
        entries = np.frombuffer(index.column("entries")[0].as_py() if len(index) else b"", PLACE)
        value = PerfectHash.from_bytes(index.column("function")[0].as_py())(ids, occurrences) if len(index) else np.full(len(ids), -1)
        known = value >= 0
        known[known] = entries["fingerprint"][value[known]] == _fingerprint(ids[known], occurrences[known])
        found, asked = entries[value[known]], asked.filter(pa.array(known))
        place = [pa.array(found[f].astype(np.int64)) for f in ("shard", "offset", "n")]
        return pa.table([asked.column("doc_id"), asked.column("occurrence"), place[0].cast(pa.int32()), *place[1:]], names=["doc_id", "occurrence", "shard", "offset", "n"])

    asked, index = _bucketed(keys, buckets).groupBy("bucket"), read_index(spark, folder).groupBy("bucket")
    return asked.cogroup(index).applyInArrow(look_up, "doc_id long, occurrence long, shard int, offset long, n long")


def read(spark: SparkSession, folder: str, places: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents at `places` (from `find`) from the shards: doc_id, occurrence, start (ids of all documents before
    it), n_tokens, ids_crc32 and, if asked for, ids (bytes, little-endian, 4 for an id).

    Places move to their shard's task, which reads them in file order. A place outside its shard raises.
    """
    manifest = read_manifest(spark, folder).select("shard", "file", "first")
    tasks = max(1, manifest.count())
    rows = places.join(manifest, "shard").select("doc_id", "occurrence", "shard", "file", "offset", "n", (F.col("first") + F.col("offset")).alias("start"))
    rows = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "offset")
    source = f"{folder}/ids" if "://" in folder else f"{folder.removeprefix('file:')}/ids"
    names = ["doc_id", "occurrence", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def parts(batches):
        opened, file, width = "", None, 0
        try:
            for batch in batches:
                sums, payload = [], []
                for name, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n"))):
                    if name != opened:
                        if file is not None:
                            file.close()
                        store, base = _open(source)
                        file, opened = store.open_input_file(f"{base}/{name}"), name
                        mark, width, _ = struct.unpack(HEADER, file.read(HEADER_BYTES))
                        if mark != MARK:
                            raise ValueError(f"{name} is no file of token ids")
                    file.seek(HEADER_BYTES + offset * width)
                    data = file.read(n * width)
                    if len(data) != n * width:
                        raise ValueError(f"{name} ends before the place {offset} to {offset + n}")
                    ids = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                    sums.append(zlib.crc32(ids))
                    if with_ids:
                        payload.append(ids)
                columns = [batch.column(c) for c in ("doc_id", "occurrence", "start", "n")] + [pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(payload, pa.binary())] * with_ids, names=names)
        finally:
            if file is not None:
                file.close()

    kind = "doc_id long, occurrence long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(parts, kind)


def keys_of(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, occurrence) of all rows of `docs`: an id that n rows have gives occurrences 0 to n - 1."""
    counts = docs.groupBy(F.col(f"`{doc_id}`").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    step = 1 << 16  # in two steps, so that no row holds a long sequence
    blocks = counts.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("at"))
    return blocks.select("doc_id", F.explode(F.sequence("at", F.least(F.col("at") + step, F.col("n")) - 1)).alias("occurrence"))


class Reader:
    """Keyed access in one process, for a training job's loader: `reader[doc_id]` or `reader[doc_id, occurrence]` gives
    an array of ids. Index buckets are read when first used; each access then reads one place of one shard."""

    def __init__(self, folder: str) -> None:
        import pyarrow.dataset as ds

        self.store, self.base = _open(folder)
        parquet = lambda name: ds.dataset(f"{self.base}/{name}", filesystem=self.store, format="parquet")
        self.files = {r["shard"]: r["file"] for r in parquet("manifest").to_table(columns=["shard", "file"]).to_pylist()}
        self.index, self.held = parquet("index"), {}
        head = self.index.head(1, columns=["buckets"])
        self.buckets = head.column("buckets")[0].as_py() if len(head) else 1

    def _bucket(self, key: int | None, occurrence: int) -> int:
        """As Spark's xxhash64 of the same columns."""
        import xxhash

        h = 42
        for v in ([] if key is None else [struct.pack("<q", key)]) + [struct.pack("<q", occurrence), struct.pack("<i", 11)]:
            h = xxhash.xxh64_intdigest(v, h)
        return (h - (1 << 64) * (h >> 63)) % self.buckets

    def __getitem__(self, key) -> np.ndarray:
        import pyarrow.compute as pc

        doc_id, occurrence = key if isinstance(key, tuple) else (key, 0)
        bucket = self._bucket(doc_id, occurrence)
        if bucket not in self.held:
            row = self.index.to_table(filter=pc.field("bucket") == bucket).to_pylist()
            self.held[bucket] = (PerfectHash.from_bytes(row[0]["function"]), np.frombuffer(row[0]["entries"], PLACE)) if row else None
        if self.held[bucket]:
            function, entries = self.held[bucket]
            ids, occurrences = _keys(pa.table({"doc_id": pa.array([doc_id], pa.int64()), "occurrence": pa.array([occurrence], pa.int64())}))
            value = function(ids, occurrences)[0]
            if value >= 0 and entries["fingerprint"][value] == _fingerprint(ids, occurrences)[0]:
                place = entries[value]
                with self.store.open_input_file(f"{self.base}/ids/{self.files[int(place['shard'])]}") as file:
                    _, width, _ = struct.unpack(HEADER, file.read(HEADER_BYTES))
                    file.seek(HEADER_BYTES + int(place["offset"]) * width)
                    return np.frombuffer(file.read(int(place["n"]) * width), f"<u{width}").astype("<u4")
        raise KeyError(key)
