"""Registered queries: each runs over whole tables, most with an equivalent ANSI SQL statement."""

from __future__ import annotations

from plumbline.queries import cleaning, decisions, evaluation, extras, modelling, modelling_facts, sources, spatial, splitting, streams
from plumbline.queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
_SECTIONS = (sources, cleaning, spatial, splitting, evaluation, decisions, modelling, modelling_facts, streams, extras)
