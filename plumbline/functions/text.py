"""Text, id and coercion expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from plumbline import fixed_values as fv


def normalise_text(c: Column) -> Column:
    """Lower case, trimmed, runs of whitespace collapsed to one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def stable_id(text: Column, qualifier: Column, prefix: str = fv.ID_PREFIX) -> Column:
    """`prefix` + first hex digits of sha256(normalised text | qualifier); a null qualifier counts as ''."""
    raw = F.concat_ws("|", F.lower(F.trim(text)), F.trim(F.coalesce(qualifier, F.lit(""))))
    return F.concat(F.lit(prefix), F.substring(F.sha2(raw, 256), 1, fv.ID_HEX_DIGITS))


def event_id(key: Column, at: Column, prefix: str = fv.INSPECTION_ID_PREFIX) -> Column:
    """Replayable record id: hash of key and event time in microseconds, the same in every time zone."""
    raw = F.concat(key.cast("string"), F.unix_micros(at.cast("timestamp")).cast("string"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(raw, 256), 1, fv.ID_HEX_DIGITS))


def to_number(c: Column, kind: str = "double") -> Column:
    """Numeric value of a text column, null where the text is no number."""
    return c.try_cast(kind)


def canonical(c: Column, spellings: Mapping[str, str] = fv.LABEL_SPELLINGS) -> Column:
    """Map the trimmed, lower-cased text through `spellings`; unmapped values become null."""
    pairs = [F.lit(x) for pair in spellings.items() for x in pair]
    return F.create_map(*pairs)[F.lower(F.trim(c))]


def label_source(label: Column, kind: Column, known: Iterable[str] = fv.KNOWN_LABELS) -> Column:
    """How a label came to be known."""
    is_known = F.coalesce(label.isin(*known), F.lit(False))
    seen = F.coalesce(F.lower(kind).contains("inspect"), F.lit(False))
    return F.when(is_known & seen, "inspected").when(is_known, "self_reported").otherwise("unknown")


def zero_pad(c: Column, width: int) -> Column:
    """Left-pad with zeros up to `width`; longer values stay whole."""
    text = c.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def tract_key(c: Column) -> Column:
    return F.concat(F.lit(fv.TRACT_PREFIX), zero_pad(c, fv.TRACT_WIDTH))
