"""Geographic expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from plumbline import fixed_values as fv

HEX_OFFSET = 1 << 30
HEX_SPAN = 1 << 31


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    )
    # rounding may lift `a` just above 1; a null coordinate must stay null, so no least()
    return F.lit(2 * fv.EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; straight-line distance there is monotone in great-circle distance."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def hex_cell(lat: Column, lon: Column, edge_m: float, lat0: float, lon0: float) -> Column:
    """BIGINT key of the pointy-top hexagon of edge `edge_m` that holds the point.

    The plane is the local equirectangular projection around (lat0, lon0); axial coordinates are rounded
    by correcting the component with the largest rounding error.
    """
    x = F.radians(lon - lon0) * F.lit(fv.EARTH_RADIUS_M * math.cos(math.radians(lat0)))
    y = F.radians(lat - lat0) * F.lit(fv.EARTH_RADIUS_M)
    q = (F.lit(math.sqrt(3.0) / 3.0) * x - y / F.lit(3.0)) / F.lit(edge_m)
    r = (F.lit(2.0 / 3.0) * y) / F.lit(edge_m)
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    cq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return (cq.cast("bigint") + F.lit(HEX_OFFSET)) * F.lit(HEX_SPAN) + cr.cast("bigint") + F.lit(HEX_OFFSET)
