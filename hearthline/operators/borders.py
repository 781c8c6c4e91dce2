"""Polygons with fewer vertices whose neighbours stay joined: borders are cut where they meet, and each piece is simplified alike on both sides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.lineage import cut_lineage

#: Fixed value: how far, in degrees, a vertex may lie from the simplified line.
TOLERANCE = 2e-4
POINT = "struct<x:double,y:double>"


def _kept(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay: its ends, and from each stretch the farthest from its chord if that is beyond the tolerance, again and again."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    left = [(0, len(p) - 1)]
    while left:
        a, b = left.pop()
        if b - a < 2:
            continue
        d, rel = p[b] - p[a], p[a + 1 : b] - p[a]
        long = d @ d
        along = np.clip(rel @ d / long, 0, 1) if long else np.zeros(len(rel))
        off = ((rel - along[:, None] * d) ** 2).sum(axis=1)
        at = int(off.argmax())
        if off[at] > tolerance * tolerance:
            keep[a + 1 + at] = True
            left += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def _simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """A line without the points it can do without; the same ones whichever way it runs."""
    turned = tuple(map(tuple, line[::-1])) < tuple(map(tuple, line))
    p = line[::-1] if turned else line
    p = p[_kept(p, tolerance)]
    return p[::-1] if turned else p


def _ring(p: np.ndarray, joint: np.ndarray, tolerance: float) -> np.ndarray:
    """An open ring simplified between its joints, closed again; without joints, between its first point in order and the farthest from that. Fewer than three points are left of a ring that vanishes."""
    n, at = len(p), np.flatnonzero(joint)
    if len(at) < 2:
        first = int(at[0]) if len(at) else int(np.lexsort((p[:, 1], p[:, 0]))[0])
        away = ((p - p[first]) ** 2).sum(axis=1)
        most = np.flatnonzero(away == away.max())
        at = np.unique([first, most[np.lexsort((p[most, 1], p[most, 0]))[0]]])
    pieces = []
    for a, b in zip(at, [*at[1:], at[0] + n]):
        pieces.append(_simplified(p[np.arange(a, b + 1) % n], tolerance)[:-1])
    out = np.concatenate(pieces)
    return np.concatenate([out, out[:1]])


def simplify(shapes: DataFrame, tolerance: float = TOLERANCE, row_id: str = "code") -> DataFrame:
    """row_id and polygons (arrays of closed rings of structs x, y) with fewer vertices, none of the old ones farther than ``tolerance`` from the new line.

    A point is a joint if its neighbours along all rings are not just two: there borders part, and it stays. Between joints every border is a line that two shapes run through in opposite directions; both
    simplify it from the same end and so keep the same points, whence no gap and no overlap arises. Joints come from one count of neighbours over all vertices; after that each ring is worked on by itself. A
    ring that is left with two points is dropped (its neighbours close over it), and with an outer ring its polygon; a shape without polygons has an empty array, a null one null.
    """
    rings = shapes.where("polygons IS NOT NULL").select(F.col(row_id).alias("id"), F.posexplode("polygons").alias("part", "rings")).select("id", "part", F.posexplode("rings").alias("ring", "p"))
    # open, without points that repeat the one before
    points = F.filter("p", lambda q, i: (i == 0) | (q != F.get("p", i - 1)))
    rings = rings.withColumn("p", points).withColumn("p", F.when(F.get("p", F.lit(0)) == F.element_at("p", -1), F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))).where("size(p) >= 3")
    rings = cut_lineage(rings.select("id", "part", "ring", F.transform("p", lambda q: F.struct(q["x"].cast("double").alias("x"), q["y"].cast("double").alias("y"))).alias("p")))
    size = F.size("p")
    around = F.transform("p", lambda q, i: F.struct(q.alias("at"), F.array(F.get("p", (i + 1) % size), F.get("p", (i + size - 1) % size)).alias("beside")))
    beside = rings.select(F.inline(around)).select("at", F.explode("beside").alias("b")).distinct()
    joints = beside.groupBy("at").count().where("count <> 2").select("at", F.lit(True).alias("joint"))
    vertices = rings.select("id", "part", "ring", F.posexplode("p").alias("place", "at")).join(joints, "at", "left")

    @F.pandas_udf(f"array<{POINT}>")
    def reduced(lines: pd.Series) -> pd.Series:
        def one(line) -> list[dict] | None:
            p, joint = np.array([(q["at"]["x"], q["at"]["y"]) for q in line]), np.array([bool(q["joint"]) for q in line])
            out = _ring(p, joint, tolerance)
            return [{"x": float(x), "y": float(y)} for x, y in out] if len(out) > 3 else None

        return lines.map(one)

    line = F.sort_array(F.collect_list(F.struct("place", "at", F.coalesce("joint", F.lit(False)).alias("joint"))))
    made = vertices.groupBy("id", "part", "ring").agg(line.alias("line")).select("id", "part", "ring", reduced("line").alias("p")).where("p IS NOT NULL")
    parts = made.groupBy("id", "part").agg(F.min("ring").alias("first"), F.sort_array(F.collect_list(F.struct("ring", "p"))).alias("r")).where("first = 0")
    whole = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", F.col("r.p").alias("rings")))).alias("s")).select(F.col("id").alias(row_id), F.col("s.rings").alias("_made"))
    joined = shapes.select(row_id, F.col("polygons").isNotNull().alias("_has")).join(whole, row_id, "left")
    return joined.select(row_id, F.when(F.col("_has"), F.coalesce("_made", F.array().cast(f"array<array<array<{POINT}>>>"))).alias("polygons"))
