"""Places on the ground as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean radius of the Earth, kilometres per degree of latitude, the latitude of the plane, and the area of interest.
RADIUS_KM, DEGREE_KM, PLANE_LATITUDE = 6371.0088, 111.32, 21.0
BOX = (20.53, 21.39, 105.28, 106.03)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM) -> Column:
    """Kilometres along the sphere; null where a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def plane_km(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y in kilometres on a plane at PLANE_LATITUDE."""
    return lon * (DEGREE_KM * math.cos(math.radians(PLANE_LATITUDE))), lat * DEGREE_KM


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = BOX) -> Column:
    """False, not null, where a coordinate is missing."""
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False))


def cell(value: Column, size: float) -> Column:
    """The number of the cell of the given size; negatives go down."""
    return F.floor(value / size)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a closed ring, an array of structs (x, y): edges half open, so a point on a shared edge is in one of two neighbours."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    crossed = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(crossed) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is in a polygon, an array of rings, the first the outer one and the others holes."""
    return F.exists(F.slice(rings, 1, 1), lambda r: in_ring(x, y, r)) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: in_ring(x, y, r))


def in_polygons(x: Column, y: Column, polygons: Column) -> Column:
    """Whether a point is in one of the polygons of an array, each an array of rings."""
    return F.exists(polygons, lambda rings: in_polygon(x, y, rings))
