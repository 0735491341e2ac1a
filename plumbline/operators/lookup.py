"""Joins against keyed reference tables.

No broadcast is forced: the reference side is one row per key, Spark broadcasts it when its measured size
allows, and otherwise adaptive execution splits a hot key of the probe side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def with_default(df: DataFrame, reference: DataFrame, on: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join; the columns named in `defaults` are filled where the key is missing."""
    joined = df.join(reference, list(on), "left")
    fills = {c: F.coalesce(F.col(c), d if isinstance(d, Column) else F.lit(d)) for c, d in defaults.items()}
    return joined.withColumns(fills)


def missing_keys(wanted: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Keys asked for that the reference does not hold."""
    return wanted.select(key).distinct().join(reference.select(key), key, "left_anti")


def restrict(df: DataFrame, wanted: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Rows whose key is wanted; with `strict` an unknown key raises."""
    if strict:
        stray = [r[0] for r in missing_keys(wanted, df, key).limit(5).collect()]
        if stray:
            raise KeyError(f"unknown {key}: {stray}")
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def enrich(df: DataFrame, dimension: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Left join of a few dimension columns; a missing key gives nulls."""
    return df.join(dimension.select(on, *columns), on, "left")
