"""Simplified polygons: joined neighbours stay joined, holes stay filled, and no old vertex is far from the new line."""

import math
import random
from collections import Counter

import pytest

from hearthline.operators import borders

SHAPES = "code string, polygons array<array<array<struct<x:double,y:double>>>>"


def wiggle(a, b, rng, n=40):
    """Points from a to b with noise, ends as they are."""
    return [a, *((a[0] + (b[0] - a[0]) * k / n + rng.uniform(-0.02, 0.02), a[1] + (b[1] - a[1]) * k / n + rng.uniform(-0.02, 0.02)) for k in range(1, n)), b]


def grid(size, rng):
    """Cells of a grid whose sides are wiggly lines, shared by two cells each."""
    lines = {}
    for i in range(size + 1):
        for j in range(size + 1):
            for d in ((1, 0), (0, 1)):
                if i + d[0] <= size and j + d[1] <= size:
                    lines[(i, j), (i + d[0], j + d[1])] = wiggle((float(i), float(j)), (float(i + d[0]), float(j + d[1])), rng)
    run = lambda a, b: lines[a, b] if (a, b) in lines else lines[b, a][::-1]
    out = {}
    for i in range(size):
        for j in range(size):
            c = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            ring = [p for k in range(4) for p in run(c[k], c[(k + 1) % 4])[:-1]]
            out[f"{i}{j}"] = [[ring + ring[:1]]]
    return out


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def away(p, ring):
    def to(a, b):
        d = (b[0] - a[0], b[1] - a[1])
        t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / ((d[0] ** 2 + d[1] ** 2) or 1)))
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    return min(to(a, b) for a, b in zip(ring, ring[1:]))


def run(spark, shapes, tolerance):
    rows = spark.createDataFrame(list(shapes.items()), SHAPES).repartition(3)
    return {r.code: None if r.polygons is None else [[[(q.x, q.y) for q in ring] for ring in p] for p in r.polygons] for r in borders.simplify(rows, tolerance).collect()}


def test_neighbours_stay_joined(spark):
    rng = random.Random(1)
    before = grid(4, rng)
    after = run(spark, before, 0.03)
    edges, count = Counter(), lambda shapes: sum(len(ring) for s in shapes.values() for p in s for ring in p)
    for code, (((*ring,),),) in ((c, s) for c, s in after.items()):
        assert ring[0] == ring[-1] and area(ring) > 0.5
        edges.update(zip(ring, ring[1:]))
        assert all(away(p, ring) <= 0.03 + 1e-12 for p in before[code][0][0])
    assert all(n == 1 for n in edges.values())
    # every side runs both ways, but for those of the outer border
    lone = [e for e in edges if e[::-1] not in edges]
    outer = lambda e: any(all(p[k] < 0.03 for p in e) or all(p[k] > 3.97 for p in e) for k in (0, 1))
    assert lone and all(map(outer, lone))
    outline = sum(a[0] * b[1] - b[0] * a[1] for a, b in lone) / 2
    assert sum(area(s[0][0]) for s in after.values()) == pytest.approx(outline, abs=1e-9)
    assert count(after) < 0.4 * count(before)


def test_a_filled_hole_and_small_shapes(spark):
    rng = random.Random(2)
    circle = [(5 + (2 + rng.uniform(-0.01, 0.01)) * math.cos(t * math.pi / 60), 5 + (2 + rng.uniform(-0.01, 0.01)) * math.sin(t * math.pi / 60)) for t in range(120)]
    shifted = circle[37:] + circle[:37]
    square = [(0.0, 0.0), (5.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    tiny = [(20.0, 20.0), (20.001, 20.0), (20.001, 20.001), (20.0, 20.0)]
    shapes = {"lake": [[circle + circle[:1]]], "land": [[square, shifted[::-1] + shifted[-1:]]], "tiny": [[tiny]], "both": [[tiny], [[(x + 30, y) for x, y in square]]], "none": [], "null": None}
    after = run(spark, shapes, 0.05)
    assert after["null"] is None and after["none"] == [] == after["tiny"] and len(after["both"]) == 1
    assert len(after["land"][0][0]) == 5  # a corner on a straight side goes
    sides = lambda ring: set(zip(ring, ring[1:]))
    assert sides(after["land"][0][1]) == {(b, a) for a, b in sides(after["lake"][0][0])} and len(after["lake"][0][0]) < 30


def test_nothing_to_do(spark):
    assert run(spark, {}, 0.1) == {}
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    kept = run(spark, {"a": [[square]]}, 1e-9)["a"][0][0]
    assert sorted(kept[:-1]) == sorted(square[:-1]) and area(kept) == 1
