"""Distances and areas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MILE_M = 1609.34
MILES_PER_DEGREE = 69.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) ** 2
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def flat_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane that touches the earth half way."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(MILES_PER_DEGREE) * F.sqrt(x**2 + (lat2 - lat1) ** 2)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def scoped_radius(radius: Column) -> Column:
    """Three quarters of a radius, 3 at least, but never more than all of it."""
    return F.least(F.greatest(radius * 0.75, F.lit(3.0)), radius)


def viewbox(lat: Column, lon: Column, miles: Column) -> Column:
    """south, west, north, east of a disc's bounding box; far north and south the box's width is bounded."""
    dlat = miles / MILES_PER_DEGREE
    dlon = miles / (F.lit(MILES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.1)))
    return F.struct((lat - dlat).alias("south"), (lon - dlon).alias("west"), (lat + dlat).alias("north"), (lon + dlon).alias("east"))


def boxes_touch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes overlap or touch, whichever way round their corners are given."""
    low = lambda box, c: F.least(box["min_" + c], box["max_" + c])
    high = lambda box, c: F.greatest(box["min_" + c], box["max_" + c])
    return (low(a, "lat") <= high(b, "lat")) & (high(a, "lat") >= low(b, "lat")) & (low(a, "lon") <= high(b, "lon")) & (high(a, "lon") >= low(b, "lon"))


def colours(neighbours: dict[int, set[int]]) -> dict[int, int]:
    """Greedy colouring in the given order: each area the least colour that no neighbour has yet."""
    out: dict[int, int] = {}
    for area, near in neighbours.items():
        taken = {out[n] for n in near if n in out}
        out[area] = next(c for c in range(len(taken) + 1) if c not in taken)
    return out
