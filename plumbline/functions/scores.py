"""Score, label and decision expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from plumbline import fixed_values as fv


def clip(c: Column, low: float, high: float) -> Column:
    """Bound to [low, high]; null stays null (greatest/least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def is_positive(label: Column, positive: str = fv.POSITIVE_LABEL) -> Column:
    return F.coalesce(label == positive, F.lit(False)).cast("int")


def is_known(label: Column, known: Iterable[str] = fv.KNOWN_LABELS) -> Column:
    """1 where the label is one of the known ones, else 0 (null counts as unknown)."""
    return F.coalesce(label.isin(*known), F.lit(False)).cast("int")


def encode_target(
    label: Column, positive: str = fv.POSITIVE_LABEL, known: Iterable[str] = fv.KNOWN_LABELS
) -> Column:
    """1/0 target; a label outside the known set stops the job."""
    stray = label.isNotNull() & ~label.isin(*known)
    message = F.concat(F.lit("label outside the known set: "), label)
    return F.when(stray, F.raise_error(message).cast("int")).otherwise(is_positive(label, positive))


def ambiguity(p: Column) -> Column:
    """1 at p = 0.5, falling linearly to 0 at p = 0 and p = 1."""
    return F.lit(1.0) - F.abs(F.lit(2.0) * clip(p, 0.0, 1.0) - F.lit(1.0))


def set_size_uncertainty(size: Column, n_classes: int = 2) -> Column:
    if n_classes <= 1:
        return F.lit(0.0)
    return clip((size.cast("double") - 1.0) / (n_classes - 1), 0.0, 1.0)


def nonconformity(y: Column, p: Column) -> Column:
    """1 - probability given to the true class."""
    return F.lit(1.0) - F.when(y == 1, p).otherwise(F.lit(1.0) - p)


def cutoff_heuristic(year: Column, cutoff: int = fv.HEURISTIC_YEAR) -> Column:
    return F.coalesce((year < cutoff).cast("double"), F.lit(0.0))


def decide(p: Column, threshold: float = fv.DECISION_THRESHOLD) -> Column:
    return p >= threshold


def round4(c: Column) -> Column:
    """Four decimals, half to even."""
    return F.bround(c, 4)


def whole_days_between(start: Column, end: Column, missing: int = fv.NO_HISTORY_DAYS) -> Column:
    """Full days from `start` to `end`: missing start gives `missing`, negative gives 0."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    days = F.floor(micros / F.lit(86_400_000_000))
    # greatest() would turn a null into 0
    return F.when(days.isNull(), F.lit(missing)).otherwise(F.greatest(days, F.lit(0))).cast("double")


def unit_hash(key: Column, seed: int) -> Column:
    """Deterministic pseudo-random value in [0, 2^32) per key, independent of row order and partitions."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 32)


def priority(
    p: Column,
    uncertainty: Column,
    boost: Column,
    strategy: str = "risk_uncertainty_equity",
    lambda1: float = 0.60,
    lambda2: float = 0.25,
    lambda3: float = 0.15,
    key: Column | None = None,
    seed: int = fv.SEED,
) -> Column:
    """Acquisition score of one strategy. `random` needs a `key` to hash."""
    if strategy == "random":
        if key is None:
            raise ValueError("the random strategy needs a key column to hash")
        return unit_hash(key, seed) / F.lit(float(1 << 32))
    if strategy == "risk":
        return p
    if strategy == "uncertainty":
        return uncertainty
    if strategy == "risk_uncertainty":
        total = lambda1 + lambda2
        return F.lit(lambda1 / total) * p + F.lit(lambda2 / total) * uncertainty
    if strategy == "risk_uncertainty_equity":
        if abs(lambda1 + lambda2 + lambda3 - 1.0) > 1e-4:
            raise ValueError("weights must sum to 1")
        return F.lit(lambda1) * p + F.lit(lambda2) * uncertainty + F.lit(lambda3) * boost
    if strategy == "oracle":
        return F.lit(0.0)
    raise ValueError(f"unknown strategy: {strategy}")


def example_weight(source: Column, weights: Mapping[str, float]) -> Column:
    """How much a row counts by where its label comes from; a source that is not named, or null, counts as 1."""
    out = F.lit(1.0)
    for name, value in weights.items():
        if value < 0:
            raise ValueError(f"weight of {name} must not be negative: {value}")
        out = F.when(source == name, F.lit(float(value))).otherwise(out)
    return out
