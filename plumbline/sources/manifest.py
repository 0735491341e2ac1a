"""Incremental ingestion: only files whose content is new, and of those only bytes not seen before are read.

Files are listed by path, length and time first. A file that the manifest knows with that length and time keeps its
digest; all others are hashed. Hashing deals a file's blocks to tasks, so one large file is the work of many, and joins
the blocks' digests to a hash tree of `FAN` digests a node: a file of one block has the SHA-256 of its content, a larger
one that of its nodes' digests. No group holds more than `FAN` rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.session import stage

MANIFEST = "name string, digest string, length long, modified timestamp, recorded timestamp"
BLOCK_BYTES = 64 << 20
READ_BYTES = 1 << 20
FAN = 1024
SETTLE_SECONDS = 2.0


def same_path(path: Column) -> Column:
    """One spelling of a path: `file:/a` and `file:///a` name the same file."""
    return F.regexp_replace(path, "^file:/+", "/")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, modified) per file; no content is read.

    A file's name is its path below `path`, so equal files of two folders are two files. Empty files, which Spark does
    not list, have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = re.sub("^file:/+", "/", path.rstrip("/")) + "/"
    name = F.substring_index(same_path(F.col("path")), root, -1)
    return files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"))


def _block_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every block (path, offset, size), read piece by piece."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size"))):
            system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            digest = hashlib.sha256()
            with system.open_input_file(inner) as file:
                file.seek(offset)
                while size:
                    piece = file.read(min(READ_BYTES, size))
                    if not piece:
                        raise OSError(f"{path} became shorter while it was read")
                    digest.update(piece)
                    size -= len(piece)
            out.append(digest.hexdigest())
        names = ["path", "name", "length", "modified", "node", "nodes"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "digest"])


def content_digests(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, name, length, modified, digest) of the listed `files`, all of which are read."""
    size = F.lit(block_bytes)
    nodes = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("long")
    blocks = files.withColumn("nodes", nodes).withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nodes") - 1)))
    blocks = blocks.withColumn("offset", F.col("node") * size).withColumn("size", F.least(size.cast("long"), F.col("length") - F.col("offset")))
    # rows are tiny and their work is not: a stated number of tasks, which adaptive execution leaves as it is
    n, most = stage(files.select(nodes.alias("nodes"))).agg(F.sum("nodes"), F.max("nodes")).first()
    tasks = max(1, min(n or 0, 16 * files.sparkSession.sparkContext.defaultParallelism))
    fields = "path string, name string, length long, modified timestamp, node long, nodes long"
    level = blocks.repartition(tasks).mapInArrow(_block_digests, f"{fields}, digest string")
    most = most or 1
    while most > 1:  # one level of the tree; a file's root goes up as it is
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda s: s["digest"]), "")
        up = F.when(F.col("nodes") > 1, F.sha2(joined, 256)).otherwise(F.first("digest"))
        keys = ["path", "name", "length", "modified", "nodes", F.floor(F.col("node") / FAN).alias("above")]
        level = level.groupBy(*keys).agg(up.alias("digest"))
        level = level.withColumn("nodes", F.ceil(F.col("nodes") / FAN).cast("long")).withColumnRenamed("above", "node")
        most = -(-most // FAN)
    return level.select("path", "name", "length", "modified", "digest")


def fingerprints(
    spark: SparkSession, path: str, manifest: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, settle: float = SETTLE_SECONDS
) -> DataFrame:
    """(path, name, digest, length, modified, hashed) per file; `hashed` is how many of its bytes were read just now.

    A file is not read if `manifest` has its name with the same length and time, recorded at least `settle` seconds
    after that time: a file system's clock may not tell a later write apart from one that happened just before.
    Digests of files over `block_bytes` depend on that size: keep one per manifest.
    """
    found = listing(spark, path)
    if manifest is None:
        manifest = spark.createDataFrame([], MANIFEST)
    late = F.col("recorded").cast("double") - F.col("modified").cast("double") >= settle
    known = manifest.where(late).groupBy("name", "length", "modified").agg(F.max_by("digest", "recorded").alias("digest"))
    found = stage(found.join(known, ["name", "length", "modified"], "left"))
    old = found.where("digest is not null").withColumn("hashed", F.lit(0).cast("long"))
    read = content_digests(found.where("digest is null").drop("digest"), block_bytes).withColumn("hashed", F.col("length"))
    return stage(old.unionByName(read).select("path", "name", "digest", "length", "modified", "hashed"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The recorded fingerprints; an absent manifest is empty. Entries without length or time vouch for no file's content."""
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or differ in content from the manifest."""
    return files.join(manifest, ["name", "digest"], "left_anti")


def record(files: DataFrame, path: str) -> None:
    """Append fingerprints to the manifest; also those of unchanged files with a new time need not be read again then."""
    files.select("name", "digest", "length", "modified", F.current_timestamp().alias("recorded")).write.mode("append").parquet(path)
