"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss.

1. One pass over the texts finds the base spans (email, ip, card, phone). They are the seeds. The same pass notes every
   other identifier-like token (a candidate) and, for seeds and candidates alike, their lexical patterns: the two
   words before, and the word before with the word after.
2. Patterns and instances form a bipartite graph, aggregated by Spark. Seeds have confidence 1 for their kind. In each
   round a pattern's confidence in a kind is the mean over its instances (with a prior against rare patterns), and a
   candidate's is the noisy-or over its patterns. Instances are identified by their text, so a candidate that is
   trusted in one place lends its trust to the patterns it has elsewhere.
3. Candidates standing in a pattern of high confidence and support become spans of the pattern's kind.

Texts are read once and never shuffled; occurrences are, without text. Patterns that occur everywhere are summed per
task before they meet.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.batches import map_rows
from plumbline.llm.tables import free, text_or_empty, written

# The base kinds in order and their patterns; a look-behind stands for "leftmost" where a run of digits
# could otherwise be entered in its middle.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

CANDIDATE = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@|\(at\)|\[at\])[A-Za-z0-9.-]{2,253}|\+?(?<![0-9A-Za-z])[0-9][0-9().-]{4,40}[0-9](?![0-9A-Za-z])")
_WORD = re.compile(r"\S+")
CONTEXT = 80
ROUNDS = 20
TOLERANCE = 1e-3
PRIOR = 2.0
MIN_CONFIDENCE = 0.8
MIN_SEEDS = 8  # with the prior, the fewest whose confidence can reach the threshold
INSTANCE_CHARS = 320
SPAN = "struct<kind: string, start: bigint, end: bigint>"
OCCURRENCE = "struct<kind: string, start: bigint, end: bigint, instance: string, patterns: array<string>>"


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Anchored at the @ signs, so that a long run of letters costs no more than its length."""
    out, free_from, sign = [], 0, -1
    for m in _DOMAIN.finditer(text):
        at = m.start()
        sign = text.rfind("@", max(sign, 0), at)
        floor = max(free_from, sign + 1)
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        sign = at
        if start < at:
            out.append((start, m.end()))
            free_from = m.end()
    return out


def _at_most_255(digits: str) -> bool:
    """Whatever the number of leading zeros."""
    rest = digits.lstrip("0")
    return len(rest) < 3 or len(rest) == 3 and rest <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_at_most_255(g) for g in m.groups())]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def lexical_patterns(text: str, start: int, end: int) -> list[str]:
    """The two words before, and the word before with the word after, in lower case; no word, no pattern."""
    before = text[max(0, start - CONTEXT) : start].lower().split()[-2:]
    after = text[end : end + CONTEXT].lower().split()[:1]
    out = [f"{before[0]} {before[1]} _"] if len(before) == 2 else []
    return out + ([f"{before[-1]} _ {after[0]}"] if before and after else [])


def _instance(text: str) -> str:
    """Short texts stand for themselves, long ones by a hash of all of them."""
    return text if len(text) <= INSTANCE_CHARS else f"#{xxhash.xxh3_128_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def occurrences(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and every seed or candidate (kind null) with its text and patterns."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    found = [(k, s, e) for k, s, e in base]
    i = 0
    for m in CANDIDATE.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            found.append((None, *m.span()))
    named = [{"kind": k, "start": s, "end": e, "instance": _instance(text[s:e].lower()), "patterns": lexical_patterns(text, s, e)} for k, s, e in found]
    return [{"kind": k, "start": s, "end": e} for k, s, e in base], named


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Rows (pattern, instance, kind or null) of single occurrences to (pattern, kind, confidence, seeds).

    `seeds` counts the pattern's distinct seed instances of the kind. Rounds go on until no confidence moves by more
    than `TOLERANCE`, `rounds` at most.
    """
    graph = written(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "graph")
    degree = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = graph.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    # patterns that no seed has can never be trusted
    patterns = written(seeds.where(F.col("seeds") >= min_seeds).join(degree, "pattern"), "patterns")
    known = graph.where("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    scores = None
    for _ in range(rounds):
        before = scores
        believed = graph.select("pattern", "instance").join(known, "instance")
        mass = believed.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        scores = patterns.join(mass, ["pattern", "kind"]).withColumn("confidence", F.least(F.lit(1.0), F.col("mass") / (F.col("n") + prior)))
        scores = written(scores.select("pattern", "kind", "confidence", "seeds"), "scores")
        if before is not None:
            moved = F.abs(F.col("confidence") - F.coalesce(F.col("earlier"), F.lit(0.0)))
            both = scores.join(before.select("pattern", "kind", F.col("confidence").alias("earlier")), ["pattern", "kind"], "left")
            if (both.agg(F.max(moved)).first()[0] or 0.0) <= TOLERANCE:
                break
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))
        derived = graph.where("kind IS NULL").select("pattern", "instance").join(scores, "pattern")
        derived = derived.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score"))
        seeded = graph.where("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("score"))
        known = written(seeded.unionByName(derived).groupBy("instance", "kind").agg(F.max("score").alias("score")), "known")
    return scores


def scan(
    docs: DataFrame, text: str = "text", rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS,
) -> DataFrame:
    """`docs` without `text`, plus base and discovered: arrays of (kind, start, end) in code points.

    A null or empty text has no spans, very long ones are read whole. Rows are independent places of the same corpus statistics; repeated rows give
    repeated results, and add nothing to a pattern's distinct instances. Where patterns of two kinds claim a candidate,
    the more confident one wins, then the kind's name. An empty table gives an empty result. Columns of `docs` called
    base or discovered are replaced.
    """
    row, seen = free(docs, "row"), free(docs, "occurrences")
    keep = [c for c in docs.columns if c != text and c.lower() not in ("base", "discovered")]

    def make():
        def one(*values):
            base, found = occurrences(values[-1])
            yield (*values[:-1], base, found)

        return one

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    found = map_rows(rows, make, ", ".join([*fields, f"base array<{SPAN}>", f"`{seen}` array<{OCCURRENCE}>"]))
    found = written(found.withColumn(row, F.monotonically_increasing_id()), "found")
    single = written(found.select(row, F.explode(seen).alias("o")).select(row, "o.*"), "occurrences")
    edges = single.select(F.explode("patterns").alias("pattern"), "instance", "kind")
    trusted = score_patterns(edges, rounds, min_seeds=min_seeds).where(F.col("confidence") >= min_confidence)
    claims = single.where("kind IS NULL").select(row, "start", "end", F.explode("patterns").alias("pattern"))
    claims = claims.join(trusted.select("pattern", F.col("kind").alias("k"), "confidence"), "pattern")
    best = claims.groupBy(row, "start", "end").agg(F.min(F.struct(-F.col("confidence"), "k"))["k"].alias("kind"))
    spans = best.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("discovered"))
    out = found.drop(seen).join(written(spans, "spans"), row, "left")
    return out.withColumn("discovered", F.coalesce("discovered", F.array().cast(f"array<{SPAN}>"))).drop(row)


def digest(spans):
    """kind:start:end by kind as listed, then start, comma-joined."""
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(place[s["kind"]].alias("p"), s["start"], s["end"], s["kind"])))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
