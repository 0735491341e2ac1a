"""Secret scans with an incremental ledger of blobs.

Every text is a version of some path. Its blob address is the SHA-256 of its bytes. The ledger, a Parquet folder, has
one row per blob and scan: the rule versions that were applied (also where nothing was found) and the findings. A scan
applies to each blob only the rule versions that the ledger lacks, appends a row, and joins findings back to all paths.

Equal texts are scanned once: blobs that the repeat filter of the exact deduplication clears go to the scan without a
shuffle, the others are reduced to one row per blob first, with a limit per task before the shuffle.
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm import exact_dedup
from plumbline.llm.batches import map_rows
from plumbline.llm.tables import free, text_or_empty, written


@dataclasses.dataclass(frozen=True)
class Rule:
    """`group` must have at least `least` characters; a match that fails is dropped and its text not searched again."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


# Patterns of the three base kinds.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
# The library's own.
EXTRA = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+"),
)
RULES = BASE + EXTRA
FINDING = "array<struct<rule string, start long, end long>>"


def apply_rules(text: str, rules: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, leftmost and non-overlapping per rule."""
    return [
        (name, m.start(), m.end()) for name, pattern, group, least in rules for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger so far, or None where no scan has been written yet."""
    try:
        return spark.read.schema(f"blob binary, tags array<string>, findings {FINDING}").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`docs` without `text`, plus blob (its content address) and findings (rule, start, end in code points).

    A null text counts as empty. Every row is a path of its own, repeated rows too; equal texts share one blob. An
    empty table gives an empty result. Columns of `docs` called blob or findings are replaced. `ledger` is a folder
    that all executors reach; it is only appended to.
    """
    spark = docs.sparkSession
    tags = [r.tag for r in rules]
    blob = F.unhex(F.sha2(text_or_empty(text), 256))
    body, flag, rank = free(docs, "body"), free(docs, "shared"), free(docs, "rank")
    texts = docs.select(blob.alias("blob"), text_or_empty(text).alias(body))
    known = _ledger(spark, ledger)
    if known is not None:
        # blob by blob what is still to do, over addresses only; texts then move for blobs with something to do
        done = known.select("blob", F.explode("tags").alias("tag")).where(F.col("tag").isin(tags))
        done = done.groupBy("blob").agg(F.collect_set("tag").alias("done")).where(F.size("done") == len(tags))
        todo = written(texts.select("blob").distinct().join(done, "blob", "left_anti"), "todo")
        part = known.select("blob", F.explode("tags").alias("tag")).where(F.col("tag").isin(tags))
        todo = todo.join(part.groupBy("blob").agg(F.collect_set("tag").alias("done")), "blob", "left")
        texts = texts.join(written(todo, "todo"), "blob")
    else:
        texts = texts.withColumn("done", F.lit(None).cast("array<string>"))
    bloom = written(exact_dedup.repeat_filter(texts.select("blob"), "blob"), "blobs")
    probed = exact_dedup.probe(texts, bloom, "blob", flag)
    one = Window.partitionBy("blob").orderBy(F.lit(1))
    repeated = probed.where(F.col(flag)).withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1)
    fresh = probed.where(~F.col(flag)).select("blob", body, "done").unionByName(repeated.select("blob", body, "done"))

    def make():
        compiled = {r.tag: (r.name, re.compile(r.pattern, re.A), r.group, r.least) for r in rules}

        def one(blob, body, done):
            missing = [t for t in tags if t not in (done or ())]
            found = apply_rules(body, [compiled[t] for t in missing])
            yield blob, missing, [{"rule": r, "start": s, "end": e} for r, s, e in found]

        return one

    map_rows(fresh, make, f"blob binary, tags array<string>, findings {FINDING}").write.mode("append").parquet(ledger)
    # findings of the rule versions asked for; blobs without any are left to the outer join
    current = {r.name: r.tag for r in rules}
    rows = _ledger(spark, ledger)
    if known is not None:  # else the ledger holds the blobs at hand and no others
        rows = rows.join(docs.select(blob.alias("blob")).distinct(), "blob", "left_semi")
    rows = rows.select("blob", "tags", F.explode("findings").alias("f"))
    tag_of = F.create_map(*[F.lit(x) for pair in current.items() for x in pair])
    rows = rows.where(F.array_contains("tags", tag_of[F.col("f.rule")]))
    found = rows.groupBy("blob").agg(F.collect_set("f").alias("findings"))  # two scans at once may both have recorded a blob
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in ("blob", "findings")]
    paths = docs.select(*keep, blob.alias("blob")).join(written(found, "found"), "blob", "left")
    return paths.withColumn("findings", F.coalesce("findings", F.array().cast(FINDING)))


def digest(found, kinds: tuple[str, ...]):
    """kind:start:end by start, then by place in `kinds`, comma-joined."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    listed = F.filter(found, lambda f: f["rule"].isin(*kinds))
    ordered = F.array_sort(F.transform(listed, lambda f: F.struct(f["start"], place[f["rule"]].alias("p"), f["end"], f["rule"])))
    return F.array_join(F.transform(ordered, lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ",")


def count_of(found, kind: str):
    return F.size(F.filter(found, lambda f: f["rule"] == kind)).cast("long")


