"""Geometry on the sphere and on planar boxes and rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from landpulse.functions.core import as_col

EARTH_RADIUS_M = 6371008.8


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; within 0.5 % of the ellipsoidal distance."""
    a1, o1, a2, o2 = (F.radians(as_col(c)) for c in (lat1, lon1, lat2, lon2))
    s1, s2 = F.sin((a2 - a1) / 2.0), F.sin((o2 - o1) / 2.0)
    h = s1 * s1 + F.cos(a1) * F.cos(a2) * s2 * s2
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bbox_coverage(reference: list, candidate: list) -> Column:
    """Share of the reference box (left, bottom, right, top) covered by the candidate box."""
    l1, b1, r1, t1 = (as_col(c) for c in reference)
    l2, b2, r2, t2 = (as_col(c) for c in candidate)
    width = F.least(r1, r2) - F.greatest(l1, l2)
    height = F.least(t1, t2) - F.greatest(b1, b2)
    area = (r1 - l1) * (t1 - b1)
    return F.when((width > 0) & (height > 0) & (area > 0), width * height / area).otherwise(0.0)


def zone_area_m2(west, south, east, north) -> Column:
    """Area of a longitude/latitude box on the authalic sphere."""
    radius = 6371007.181
    span = F.radians(as_col(east) - as_col(west))
    return F.abs(radius * radius * span * (F.sin(F.radians(as_col(north))) - F.sin(F.radians(as_col(south)))))


def ring_area(ring) -> Column:
    """Absolute shoelace area of a closed or open ring of (x, y) structs."""
    ring = as_col(ring)
    n = F.size(ring)
    twice = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0.0),
        lambda acc, i: acc + (F.element_at(ring, i)["x"] * F.element_at(ring, F.pmod(i, n) + 1)["y"]
                              - F.element_at(ring, F.pmod(i, n) + 1)["x"] * F.element_at(ring, i)["y"]))
    return F.abs(twice) / 2.0


def ring_contains(ring, x, y) -> Column:
    """Even-odd test of a point against a ring of (x, y) structs."""
    ring, x, y = as_col(ring), as_col(x), as_col(y)
    n = F.size(ring)

    def crosses(i):
        a, b = F.element_at(ring, i), F.element_at(ring, F.pmod(i, n) + 1)
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    count = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + crosses(i))
    return count % 2 == 1


def degrees_to_m2(area_deg2, mid_lat) -> Column:
    scale = 111319.5
    return as_col(area_deg2) * scale * scale * F.cos(F.radians(as_col(mid_lat)))


def equivalent_width(area_m2) -> Column:
    return 2.0 * F.sqrt(F.greatest(F.lit(0.0), as_col(area_m2)) / math.pi)
