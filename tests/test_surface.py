"""Surfaces against a direct sum over rows, and bands as polygons: closed rings, orientation, holes, and every point in the band that its value says."""

import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import surface


def value_at(grid, x, y):
    """Linear over the four triangles of a square; None outside."""
    i, j = math.floor(x), math.floor(y)
    v = [grid.get((i + a, j + b)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    if None in v:
        return None
    m, u, w = sum(v) / 4, x - i - 0.5, y - j - 0.5
    a, b = {True: (0, 1), False: (3, 2)}[w < 0] if abs(w) >= abs(u) else {True: (0, 3), False: (1, 2)}[u < 0]
    along, out = (u, abs(w)) if abs(w) >= abs(u) else (w, abs(u))
    return m + (v[a] + v[b] - 2 * m) * out + (v[b] - v[a]) * along


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        odd ^= (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return odd


def area(ring):
    return sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:])) / 2


def check(spark, grid, levels, points=600):
    cells = spark.createDataFrame([(i, j, float(v)) for (i, j), v in grid.items()], "cx long, cy long, v double").repartition(3)
    rows = surface.iso_bands(cells, "v", levels).collect()
    polygons = defaultdict(list)
    for r in rows:
        each = [[(q.x, q.y) for q in ring] for ring in r.rings]
        assert all(p[0] == p[-1] and len(p) > 3 and len(set(zip(p, p[1:]))) == len(p) - 1 for p in each)  # closed, and along no edge twice
        assert area(each[0]) > 0 and all(area(h) < 0 for h in each[1:]) and r.area == pytest.approx(sum(map(area, each)))
        assert all(inside(each[0], *np.mean([h[0], h[1]], axis=0)) or min(h)[0] >= min(each[0])[0] for h in each[1:])
        polygons[r.band].append(each)
    rng = random.Random(1)
    side = max(i for i, _ in grid)
    for _ in range(points):
        x, y = rng.uniform(-0.5, side + 0.5), rng.uniform(-0.5, side + 0.5)
        v = value_at(grid, x, y)
        want = None if v is None else sum(level <= v for level in levels)
        if v is not None and min(abs(v - level) for level in levels) < 1e-9:
            continue
        at = [b for b, ps in polygons.items() for p in ps if inside(p[0], x, y) and not any(inside(h, x, y) for h in p[1:])]
        assert at == ([] if want is None else [want])
    return polygons


def test_bands_of_noise_with_gaps(spark):
    rng = random.Random(3)
    grid = {(i, j): rng.uniform(0, 10) for i in range(14) for j in range(14) if rng.random() > 0.06}
    assert len(check(spark, grid, [2.0, 4.5, 7.0])) == 4


def test_values_on_levels_and_saddles(spark):
    """Whole numbers on the levels themselves: plateaus, points where a band touches itself, and saddles."""
    rng = random.Random(5)
    check(spark, {(i, j): rng.randint(0, 3) for i in range(12) for j in range(12)}, [1.0, 2.0])
    check(spark, {(i, j): (i + j) % 2 for i in range(7) for j in range(7)}, [0.5])


def test_rings_in_rings(spark):
    """A ripple: rings around rings, each hole with the ring it is cut from."""
    grid = {(i, j): math.cos(math.hypot(i - 20, j - 20) / 2.5) for i in range(41) for j in range(41)}
    polygons = check(spark, grid, [0.0])
    assert sorted(len(p) for p in polygons[1]) == [1, 1, 1, 1, 1, 2, 2] or any(len(p) == 2 for p in polygons[1])
    assert all(len(p) >= 1 for b in polygons.values() for p in b)


def test_two_holes_side_by_side(spark):
    grid = {(i, j): 1.0 for i in range(16) for j in range(9)}
    grid.update({(4, 4): -1.0, (8, 4): -1.0, (12, 4): -1.0, (12, 2): -1.0})
    polygons = check(spark, grid, [0.0])
    assert [len(p) for p in polygons[1]] == [5] and [len(p) for p in polygons[0]] == [1] * 4


def test_surface_equals_direct_sums(spark):
    rng = random.Random(7)
    rows = [(i, 20.9 + rng.random() / 5, 105.7 + rng.random() / 5, rng.choice([0.1, 0.8, None]), rng.lognormvariate(3, 1)) for i in range(150)] + [(900, None, 105.8, 0.1, 5.0), (901, 21.0, 105.8, 0.1, None), (902, 21.0, 105.8, 0.1, -4.0)]
    df = spark.createDataFrame(rows, "row_id long, lat double, lon double, e double, price double")
    got = {(r.cx, r.cy): r for r in surface.price_surface(df, "price", 0.5, F.col("e")).collect()}
    sums = defaultdict(lambda: np.zeros(3))
    for _, lat, lon, e, price in rows:
        if lat is None or not price or price < 0:
            continue
        w = max(0.79 if e is None else e, 0.30) / 0.5
        reach = math.floor(4 * w + 0.5)
        d = np.arange(-reach, reach + 1)
        k = np.exp(-((d / w) ** 2) / 2)
        k /= k.sum()
        cx, cy = math.floor(lon * 111.32 * math.cos(math.radians(21)) / 0.5), math.floor(lat * 111.32 / 0.5)
        for a, x in zip(k, d):
            for b, y in zip(k, d):
                sums[cx + x, cy + y] += a * b * np.array([1, math.log(price), math.log(price) ** 2])
    sums = {c: v for c, v in sums.items() if round(v[0], 9) > 0}
    least = np.quantile([round(v[0], 9) for v in sums.values()], 0.18)
    assert set(got) == set(sums)
    for c, (n, s, ss) in sums.items():
        assert got[c]["mean"] == pytest.approx(math.exp(s / n), rel=1e-6) and got[c].dispersion == pytest.approx(math.exp(math.sqrt(max(ss / n - (s / n) ** 2, 0))) - 1, abs=1e-4)
        assert abs(n - least) < 1e-9 or got[c].dense == (n >= least)


def test_features_and_no_cells(spark):
    empty = spark.createDataFrame([], "cx long, cy long, v double")
    assert surface.iso_bands(empty, "v", [1.0]).count() == 0 and surface.levels_between(empty, "v", 3) == []
    cells = spark.createDataFrame([(i, j, float(i)) for i in range(3) for j in range(3)], "cx long, cy long, v double")
    rows = surface.band_features(surface.iso_bands(cells, "v", [0.5]), [0.5], 2.0).orderBy("band").collect()
    assert [(r.low, r.high) for r in rows] == [(None, 0.5), (0.5, None)]
    shape = json.loads(rows[0].geometry)
    assert shape["type"] == "Polygon" and shape["coordinates"][0][0] == shape["coordinates"][0][-1] and len(shape["coordinates"][0][0]) == 2
    with pytest.raises(ValueError):
        surface.iso_bands(cells, "v", [2.0, 1.0])
