"""Statistics of areas and of what lies near: quantile tables, grids, pins, polygons, neighbours, coordinate cascades."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.geo import RADIUS_KM, cell, haversine_km, in_polygons, plane_km
from hearthline.operators.lineage import cut_lineage
from hearthline.operators.quantiles import exact_quantiles, median_places


def quantile_table(df: DataFrame, groups: list[str], value: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), least: int = 1, count: str | None = None) -> DataFrame:
    """groups, n and q25, q50, ... (exact, interpolated) of groups with ``least`` or more values; null keys are no group. ``count``: a column of how many rows a row stands for."""
    known = reduce(lambda a, b: a & b, (F.col(g).isNotNull() for g in groups))
    agg = exact_quantiles(df.where(known), groups, value, {f"q{round(100 * q):02d}": q for q in quantiles}, count=count)
    if least < 1:  # groups without a value have a row too
        agg = df.where(known).select(*groups).distinct().join(agg, groups, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return agg.where(F.col("n") >= least)


def ward_table(df: DataFrame, least: int = 20) -> DataFrame:
    """Per ward (ward, district, price): n, quartiles, majority district (of equals the first by name), gap to the city's median and spread in per cent, rank by median; wards of fewer than ``least`` are left out.

    df is read once: all comes from the counts of its equal rows.
    """
    df = cut_lineage(df.groupBy("ward", "district", F.col("price").cast("double").alias("price")).count())
    stats = quantile_table(df, ["ward"], "price", least=least, count="count")
    votes = df.groupBy("ward", "district").agg(F.sum("count").alias("count"))
    first = F.row_number().over(Window.partitionBy("ward").orderBy(F.desc("count"), F.asc_nulls_last("district")))
    majority = votes.withColumn("_r", first).where("_r = 1").select("ward", "district")
    city = exact_quantiles(df, [], "price", {"city": 0.5}, count="count").select("city")
    out = stats.join(majority, "ward", "left").join(F.broadcast(city))
    out = out.withColumn("gap", 100 * (F.col("q50") / F.col("city") - 1)).withColumn("spread", 100 * (F.col("q75") - F.col("q25")) / F.col("q50"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("q50"), "ward"))).drop("city")


def mode_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, the most frequent value (of equals the smallest), its distinct values and the rows."""
    return df.groupBy(*keys).agg(F.mode(value, True).alias(value), F.count_distinct(value).alias("n_values"), F.count("*").alias("n"))


def adaptive_grid(df: DataFrame, value: str = "price", sizes: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0), least: int = 5) -> DataFrame:
    """size, cx, cy, n and quartiles of cells: a row settles in the finest cell where ``least`` or more not yet settled rows are; the last size takes all."""
    x, y = plane_km(F.col("lat"), F.col("lon"))
    left = df.where("lat IS NOT NULL AND lon IS NOT NULL").select(x.alias("x"), y.alias("y"), value).withColumn("size", F.lit(None).cast("double"))
    for size in sizes:
        free = F.col("size").isNull()
        at = [F.when(free, cell(F.col(c), size)) for c in ("x", "y")]
        many = F.count("*").over(Window.partitionBy(free, *at))
        left = left.withColumn("size", F.coalesce("size", F.when(F.lit(size == sizes[-1]) | (many >= least), F.lit(size))))
    at = [F.floor(F.col(c) / F.col("size")).alias(f"c{c}") for c in ("x", "y")]
    return quantile_table(left.select("size", *at, value), ["size", "cx", "cy"], value)


def pins(df: DataFrame, places: int = 4) -> DataFrame:
    """Rows with the number of listings at their rounded place."""
    key = [F.bround("lat", places), F.bround("lon", places)]
    return df.withColumn("at_pin", F.count("*").over(Window.partitionBy(*key)))


def thin(df: DataFrame, size_km: float, weight: str, row_id: str = "row_id") -> DataFrame:
    """One row per cell, that of the greatest weight (of equals the smallest row_id)."""
    x, y = plane_km(F.col("lat"), F.col("lon"))
    first = F.row_number().over(Window.partitionBy(cell(x, size_km), cell(y, size_km)).orderBy(F.desc(weight), row_id))
    return df.withColumn("_r", first).where("_r = 1").drop("_r")


def _around(points: DataFrame, km: float, prefix: str) -> DataFrame:
    """Points with the nine cells of km around them: each of a pair within km is in a cell of the other's nine."""
    x, y = plane_km(F.col(f"{prefix}lat"), F.col(f"{prefix}lon"))
    side = F.array(*map(F.lit, (-1, 0, 1)))
    return points.withColumn("gx", F.explode(F.transform(side, lambda d: cell(x, km) + d))).withColumn("gy", F.explode(F.transform(side, lambda d: cell(y, km) + d)))


def pairs_within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Every left row (columns l_...) with every right row (r_...) at most km away, and the distance: an equi-join on cells, whose count is bounded by the density and not by the table."""
    # cells a little wider than km: plane and sphere differ by up to a few per cent at the edge of the area
    wide = km * 1.1
    a = left.toDF(*(f"l_{c}" for c in left.columns))
    b = _around(right.toDF(*(f"r_{c}" for c in right.columns)), wide, "r_")
    x, y = plane_km(F.col("l_lat"), F.col("l_lon"))
    a = a.withColumn("gx", cell(x, wide)).withColumn("gy", cell(y, wide))
    joined = a.join(b, ["gx", "gy"]).withColumn("km", haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    return joined.where(F.col("km") <= km).drop("gx", "gy")


def dense_pins(df: DataFrame, km: float = 1.0, least: int = 5, places: int = 4) -> DataFrame:
    """Rows whose rounded place has ``least`` or more other distinct places within km.

    Places that share a cell of a diagonal below km are that near to one another, so a cell of more than ``least`` settles all of its own. Only places of cells with fewer are compared,
    of which each cell has at most ``least``: a place is met by a bounded number of them, however dense its surroundings.
    """
    place = df.select(F.bround("lat", places).alias("lat"), F.bround("lon", places).alias("lon")).where((F.abs("lat") < math.inf) & (F.abs("lon") < math.inf)).distinct()
    # a parallel is longest on the equator, so at every latitude a cell of degrees is at most this wide; its diagonal is 0.92 km
    side = 0.65 * km / 111.32
    own = [F.floor(F.col("lat") / side), F.floor(F.col("lon") / side)]
    place = cut_lineage(place.withColumn("_many", F.count("*").over(Window.partitionBy(*own)) > least))
    few = place.where("NOT _many").select("lat", "lon")
    near = pairs_within(few, place.select("lat", "lon"), km).where("l_lat <> r_lat OR l_lon <> r_lon").groupBy("l_lat", "l_lon").count().where(F.col("count") >= least)
    near = near.select("l_lat", "l_lon").unionByName(place.where("_many").select(F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon")))
    on = (F.bround("lat", places) == F.col("l_lat")) & (F.bround("lon", places) == F.col("l_lon"))
    return df.join(near, on, "left_semi")


def within(df: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows at most km from a place, with km: a box first, which reaches the scan, then the distance."""
    d_lat, d_lon = km / 110.0, km / 100.0
    box = F.col("lat").between(lat - d_lat, lat + d_lat) & F.col("lon").between(lon - d_lon, lon + d_lon)
    return df.where(box).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).where(F.col("km") <= km)


def _cube(lat: str, lon: str) -> list[Column]:
    """A place as a point of the sphere in kilometres, moved so that no coordinate is negative: straight distances order places as those on the ground do, at every latitude and across the date line."""
    a, b = F.radians(lat), F.radians(lon)
    return [RADIUS_KM * (1 + c) for c in (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))]


#: The side of the cube of level 0, beyond the Earth's diameter, and the finest level (cells of four metres).
CUBE_KM, FINEST = 16384.0, 22


def nearest(df: DataFrame, base: DataFrame, k: int, km: float | None = None, row_id: str = "row_id", itself: bool = False) -> DataFrame:
    """l_row_id, r_row_id, km, rank: the k nearest base rows of each row, at any distance or within km, itself (the row of the same id) left out unless asked for; of equal distances the smaller id. Rows without a place have none.

    Cells halve from level to level. A row's own cell at the finest level where it holds more than k base rows bounds the distance of the k-th by its
    diagonal, and the cells around one twice as wide hold everything within that: so one equi-join finds all, near in dense places and far in thin ones.
    A far row is compared with all that is in the wide cells around it, however dense.
    """
    left, right = (d.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").select(F.col(row_id).alias(f"{p}_{row_id}"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"), *(c.alias(f"{p}_{n}") for n, c in zip("xyz", _cube("lat", "lon")))) for d, p in ((df, "l"), (base, "r")))
    # of rows at one place only the first k + 1 can be among the k nearest of any row
    place = Window.partitionBy("r_lat", "r_lon").orderBy(f"r_{row_id}")
    right = right.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1).drop("_n")
    cells = ["level", "gx", "gy", "gz"]
    at = lambda p: [F.floor(F.col(f"{p}_{c}") * F.pow(F.lit(2.0), F.col("level")) / CUBE_KM).alias(f"g{c}") for c in "xyz"]
    fine = F.explode(F.sequence(F.lit(1), F.lit(FINEST))).alias("level")
    full = right.select("*", fine).groupBy("level", *at("r")).count().where(F.col("count") > k).drop("count")
    own = left.select(f"l_{row_id}", fine, *(f"l_{c}" for c in "xyz")).select(f"l_{row_id}", "level", *at("l")).join(full, cells).groupBy(f"l_{row_id}").agg(F.max("level").alias("level"))
    side = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    ready = left.join(own, f"l_{row_id}", "left").withColumn("level", F.greatest(F.coalesce("level", F.lit(0)) - 1, F.lit(0)))
    ready = ready.select("*", *at("l"))
    for g in cells[1:]:
        ready = ready.withColumn("d", side).withColumn(g, F.col(g) + F.col("d")).drop("d")
    found = ready.join(right.select("*", F.explode(F.sequence(F.lit(0), F.lit(FINEST - 1))).alias("level")).select("*", *at("r")), cells)
    square = sum((F.pow(F.col(f"l_{c}") - F.col(f"r_{c}"), F.lit(2)) for c in "xyz"), F.lit(0.0))
    # the own cell has half the side: three quarters of this square; a little more for rounding
    wide = F.pow(F.lit(CUBE_KM) / F.pow(F.lit(2.0), F.col("level")), F.lit(2))
    found = found.where((square <= 0.76 * wide) | (F.col("level") == 0))
    if not itself:
        found = found.where(f"l_{row_id} <> r_{row_id}")
    found = found.select(f"l_{row_id}", f"r_{row_id}", haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")).alias("km"))
    if km is not None:
        found = found.where(F.col("km") <= km)
    order = Window.partitionBy(f"l_{row_id}").orderBy("km", f"r_{row_id}")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: How many places are compared with points of interest at a time, and how many of these share bounds of their distances.
CHUNK, GROUP = 4096, 64


def _haversine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """haversine_km of rows (lat, lon)."""
    lat1, lon1, lat2, lon2 = (np.radians(v) for v in (a[:, 0], a[:, 1], b[:, 0], b[:, 1]))
    h = np.sin(np.radians(b[:, 0] - a[:, 0]) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(np.radians(b[:, 1] - a[:, 1]) / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _chord(km: float) -> float:
    """The square of the straight distance between places km apart on the ground."""
    return (2 * RADIUS_KM * math.sin(min(km / (2 * RADIUS_KM), math.pi / 2))) ** 2


class _Around:
    """Up to CHUNK places, and how many points of each kind were seen within km of each, and the nearest of them.

    Places are dealt to groups of GROUP neighbours. A point that is within km of all of a group's box counts for all of its places at once, one beyond km of the box for none; only what
    lies on the edge is compared place by place, and for the nearest what lies no further than the box's furthest corner from another point of the kind.
    """

    def __init__(self, places: np.ndarray, kinds: int, km: float) -> None:
        strips = max(1, round(math.sqrt(len(places) / GROUP)))
        strip = np.argsort(np.argsort(places[:, 0], kind="stable")) * strips // len(places)
        self.places, self.km, self.limit, self.slack = places[np.lexsort((places[:, 1], strip))], km, _chord(km), 1e-6 * (1 + km)
        ends = np.cumsum(np.bincount(strip))  # no group goes on in another strip, or its box would be as long as both
        self.groups = [slice(i, min(i + GROUP, end)) for start, end in zip([0, *ends[:-1]], ends) for i in range(start, end, GROUP)]
        self.low, self.high = (np.array([f(self.places[g, 2:], axis=0) for g in self.groups]) for f in (np.min, np.max))
        self.count, self.near = np.zeros((len(places), kinds), np.int64), np.full((len(places), kinds), np.inf)
        self.reach = np.full((len(self.groups), kinds), self.limit + self.slack)

    def see(self, kind: np.ndarray, n: np.ndarray, points: np.ndarray) -> None:
        """Points (lat, lon, x, y, z) with their kinds and how often each is there."""
        order = np.argsort(kind, kind="stable")
        kind, n, points = kind[order], n[order], points[order]
        own, first = np.unique(kind, return_index=True)
        weight = np.zeros((len(kind), self.count.shape[1]))
        weight[np.arange(len(kind)), kind] = n
        least, most = (np.zeros((len(self.groups), len(kind))) for _ in range(2))
        for i in range(3):
            under, over = self.low[:, i, None] - points[None, :, 2 + i], points[None, :, 2 + i] - self.high[:, i, None]
            least += np.maximum(np.maximum(under, over), 0.0) ** 2
            most += np.minimum(under, over) ** 2  # the further side of the box: both are negative inside it
        self.reach[:, own] = np.minimum(self.reach[:, own], np.minimum.reduceat(most, first, axis=1) + self.slack)
        inside = most <= self.limit - self.slack
        whole = np.rint(inside @ weight).astype(np.int64)
        edge, close = (least <= self.limit + self.slack) & ~inside, least <= self.reach[:, kind]
        for g, group in enumerate(self.groups):
            self.count[group] += whole[g]
            places = self.places[group]
            at = np.flatnonzero(edge[g])
            if len(at):
                square = sum((places[:, 2 + i, None] - points[None, at, 2 + i]) ** 2 for i in range(3))
                within = square <= self.limit
                a, b = np.nonzero(np.abs(square - self.limit) <= self.slack)
                within[a, b] = _haversine(places[a], points[at[b]]) <= self.km
                self.count[group] += np.rint(within @ weight[at]).astype(np.int64)
            at = np.flatnonzero(close[g])
            if len(at):
                a, b = np.divmod(np.arange(len(places) * len(at)), len(at))
                away = _haversine(places[a], points[at[b]]).reshape(len(places), len(at))
                of, start = np.unique(kind[at], return_index=True)
                self.near[group, of] = np.minimum(self.near[group, of], np.minimum.reduceat(away, start, axis=1))

    def rows(self) -> pd.DataFrame:
        near = np.where(self.near <= self.km, self.near, np.nan)
        return pd.DataFrame({"lat": self.places[:, 0], "lon": self.places[:, 1], "count": list(self.count), "near": list(near)})


def _counted(batches: Iterator[pd.DataFrame], kinds: int, km: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell and chunk, places (kind -1) before points: a row per place with counts and distances by kind. One chunk of places and one batch of points are held at a time."""
    key, places, around = None, [], None
    for batch in batches:
        ids, kind, n, at = batch[["cell", "chunk"]].to_numpy(), batch["kind"].to_numpy(), batch["n"].to_numpy(), batch[["lat", "lon", "x", "y", "z"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)]) if len(ids) else []
        for start, end in zip(starts, [*starts[1:], len(ids)]):
            if key != tuple(ids[start]):
                if around:
                    yield around.rows()
                key, places, around = tuple(ids[start]), [], None
            split = start + int((kind[start:end] < 0).sum())
            if split > start:
                places.append(at[start:split])
            if end > split and places:
                around = around or _Around(np.concatenate(places), kinds, km)
                around.see(kind[split:end], n[split:end], at[split:end])
    if around:
        yield around.rows()


def poi_features(df: DataFrame, poi: DataFrame, kinds: tuple[str, ...], km: float, row_id: str = "row_id") -> DataFrame:
    """row_id with near_<kind> (kilometres to the nearest, null beyond km) and count_<kind> for each kind of poi (kind, lat, lon).

    Equal places are one, and so are equal points of a kind. Places of a cell go to tasks by CHUNK, with the points no further than km from the chunk's box, in batches; only those near the edge of a
    circle are compared one by one (_Around). Cells are cubes, so that every latitude is served alike.
    """
    finite = (F.abs("lat") < math.inf) & (F.abs("lon") < math.inf)
    xyz = [c.alias(n) for n, c in zip("xyz", _cube("lat", "lon"))]
    level = min(18, max(0, math.floor(math.log2(2 * CUBE_KM / (1.0001 * km)))))
    side = CUBE_KM / 2**level

    def number(size: float, shift: tuple[Column | int, ...] = (0, 0, 0)) -> Column:
        at = [F.floor(F.col(c) / size) + d for c, d in zip("xyz", shift)]
        return F.shiftleft(at[0], 42) + F.shiftleft(at[1], 21) + at[2]

    place = df.select("lat", "lon").where(finite).distinct().select("lat", "lon", *xyz).withColumn("cell", number(side))
    inside = Window.partitionBy("cell").orderBy(number(side / 4), "lat", "lon")
    place = cut_lineage(place.withColumn("chunk", F.floor((F.row_number().over(inside) - 1) / CHUNK)))
    kind = (F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1).cast("int")
    point = poi.select(kind.alias("kind"), "lat", "lon").where(finite & (F.col("kind") >= 0)).groupBy("kind", "lat", "lon").agg(F.count("*").alias("n"))
    point = cut_lineage(point.select("kind", "n", "lat", "lon", *xyz).withColumn("cell", number(side)))

    def boxes(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))))

    # chunks beside the cells of points that may be within reach, then beside their points
    reach = math.floor(1.0001 * km / side) + 1
    steps = F.array(*map(F.lit, range(-reach, reach + 1)))
    cells = boxes(point, "cell").withColumnsRenamed({f"{n}_{c}": f"p_{n}_{c}" for c in "xyz" for n in ("low", "high")}).withColumnRenamed("cell", "at")
    moved = cells.select("*", *(F.shiftright("at", 42 - 21 * i).bitwiseAND(F.lit(2**21 - 1).cast("long")).alias(f"g{c}") for i, c in enumerate("xyz")))
    for c in "xyz":
        moved = moved.withColumn("d", F.explode(steps)).withColumn(f"g{c}", F.col(f"g{c}") + F.col("d")).where(F.col(f"g{c}") >= 0).drop("d")
    moved = moved.withColumn("cell", F.shiftleft("gx", 42) + F.shiftleft("gy", 21) + F.col("gz")).drop("gx", "gy", "gz")
    far = _chord(km) + 1e-6 * (1 + km)
    away = lambda low, high: sum((F.pow(F.greatest(F.col(f"low_{c}") - high(c), low(c) - F.col(f"high_{c}"), F.lit(0.0)), F.lit(2)) for c in "xyz"), F.lit(0.0))
    chunks = boxes(place, "cell", "chunk").join(moved, "cell").where(away(lambda c: F.col(f"p_low_{c}"), lambda c: F.col(f"p_high_{c}")) <= far)
    chunks = chunks.select("cell", "chunk", "at", *(f"{n}_{c}" for c in "xyz" for n in ("low", "high")))
    near = chunks.join(point.withColumnRenamed("cell", "at"), "at").where(away(F.col, F.col) <= far)
    columns = ["cell", "chunk", "kind", "n", "lat", "lon", "x", "y", "z"]
    rows = place.withColumns({"kind": F.lit(-1), "n": F.lit(1).cast("long")}).select(columns).unionByName(near.select(columns))
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(tasks, "cell", "chunk").sortWithinPartitions("cell", "chunk", F.col("kind") >= 0)
    found = dealt.mapInPandas(lambda batches: _counted(batches, len(kinds), km), "lat double, lon double, count array<long>, near array<double>")
    out = df.select(row_id, "lat", "lon").join(found, ["lat", "lon"], "left")
    each = [c for i, k in enumerate(kinds) for c in (F.when(~F.isnan(F.col("near")[i]), F.col("near")[i]).alias(f"near_{k}"), F.coalesce(F.col("count")[i], F.lit(0).cast("long")).alias(f"count_{k}"))]
    return out.select(row_id, *each)


def closeness(km: Column, decay: float) -> Column:
    """1 at the place, falling by e per decay; 0 if there is none."""
    return F.coalesce(F.exp(-km / decay), F.lit(0.0))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """1 to 100 from scores of 0 to 1."""
    return 1 + 99 * reduce(lambda a, b: a + b, (c * w for c, w in parts)) / sum(w for _, w in parts)


def contains(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points (lat, lon) with every polygon (polygon, parts: an array of polygons, each an array of rings of x = lon and y = lat, the first the outer one and the others holes) that holds them: boxes of polygons, cut into cells of a twentieth of a degree, then the rings.

    Polygons are only as many as wards, but nothing relies on that: the join is on cells.
    """
    size = 0.05
    outer = F.flatten(F.transform("parts", lambda rings: rings[0]))
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    boxed = polygons.select("*", *(F.explode(F.sequence(F.floor(F.array_min(v) / size), F.floor(F.array_max(v) / size))).alias(n) for v, n in ((xs, "gx"),)))
    boxed = boxed.withColumn("gy", F.explode(F.sequence(F.floor(F.array_min(ys) / size), F.floor(F.array_max(ys) / size))))
    at = points.withColumn("gx", F.floor(F.col("lon") / size)).withColumn("gy", F.floor(F.col("lat") / size))
    return at.join(boxed, ["gx", "gy"]).where(in_polygons(F.col("lon"), F.col("lat"), F.col("parts"))).drop("gx", "gy", "parts")


def quantile_classes(stats: DataFrame, value: str, classes: int = 7, least: int = 20) -> DataFrame:
    """Adds class: the number of inner quantile edges below the value, -1 for groups of fewer than ``least``."""
    names = {f"e{i}": i / classes for i in range(1, classes)}
    edges = exact_quantiles(stats.where(F.col("n") >= least), [], value, names).select(F.array(*names).alias("edges"))
    return stats.join(F.broadcast(edges)).withColumn("class", F.when(F.col("n") >= least, F.size(F.filter("edges", lambda e: e < F.col(value)))).otherwise(-1)).drop("edges")


def nearest_centre(points: DataFrame, centres: DataFrame, row_id: str = "row_id") -> DataFrame:
    """row_id, centre, km: the nearest of a table of centres (centre, lat, lon), of equals the first; found by cells, however many centres there are."""
    base = centres.select(F.col("centre").alias("c_id"), "lat", "lon")
    found = nearest(points.select(F.col(row_id).alias("c_id"), "lat", "lon"), base, k=1, row_id="c_id", itself=True)
    return found.select(F.col("l_c_id").alias(row_id), F.col("r_c_id").alias("centre"), "km")


def cascade(df: DataFrame, levels: list[tuple[str, list[str]]], least: int = 3) -> DataFrame:
    """Adds lat_found, lon_found, level and support: own coordinates ('own'), else the median of the rows with coordinates that share the first level's keys, and so on; level is null if none has ``least`` rows.

    ``levels``: (name, keys), the finest first. The medians of all levels are found together, and each level is one join; a null key matches nothing.
    """
    out = df
    for i, ((_, keys), table) in enumerate(zip(levels, median_places(df, [keys for _, keys in levels]))):
        table = table.where(F.col("n") >= least).withColumnsRenamed({c: f"_{c}{i}" for c in ("lat", "lon", "n")})
        out = out.join(table, keys, "left")
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    pick = lambda first, cols: F.coalesce(F.when(own, first), *cols)
    n = range(len(levels))
    out = out.withColumn("level", pick(F.lit("own"), [F.when(F.col(f"_n{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(levels)]))
    out = out.withColumn("support", pick(F.lit(1), [F.col(f"_n{i}") for i in n]))
    out = out.withColumn("lat_found", pick(F.col("lat"), [F.col(f"_lat{i}") for i in n])).withColumn("lon_found", pick(F.col("lon"), [F.col(f"_lon{i}") for i in n]))
    return out.drop(*(f"_{c}{i}" for i in n for c in ("lat", "lon", "n")))


def with_left_out_median(df: DataFrame, value: str, group: list[str], name: str, buckets: int = 256) -> DataFrame:
    """Adds ``name``, the median of the others of the row's group, of any size; null groups are a group, and a row without others has none.

    Values with their counts fall into buckets between approximate quantiles of their group. Counts of buckets tell which ones hold the (up to three) middle ranks; only
    these are sorted, each by itself, and a row takes its two of the few values found. So no task holds or sorts more than about one bucket of a group.
    """
    known = df.where(F.col(value).isNotNull()).select(F.struct(*group).alias("g"), F.col(value).alias("v"))
    cuts = known.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 100 * buckets).alias("cuts"))
    counted = known.groupBy("g", "v").agg(F.count("*").alias("c")).join(cuts, "g").withColumn("bucket", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    counted = cut_lineage(counted)  # approximate quantiles may differ from run to run
    upto = lambda *by: F.sum("c").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]))
    full = counted.groupBy("g", "n", "bucket").agg(F.sum("c").alias("c")).withColumn("before", upto("g", "bucket") - F.col("c"))
    # the middle of the n - 1 others: ranks low and high, each one further on if the row's own value comes first
    low, high = F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2) + 1
    ranks = F.array(low, low + 1, high, high + 1)
    held = lambda first, last: F.filter(ranks, lambda r: (r > first) & (r <= last))
    full = full.where(F.size(held(F.col("before"), F.col("before") + F.col("c"))) > 0).select("g", "bucket", "before")
    inside = counted.join(full, ["g", "bucket"]).withColumn("last", F.col("before") + upto("g", "bucket", "v"))
    at = [F.max(F.when((r > F.col("last") - F.col("c")) & (r <= F.col("last")), F.col("v"))).alias(f"_{i}") for i, r in enumerate((low, low + 1, high, high + 1))]
    middle = inside.groupBy("g").agg(*at, F.max("n").alias("_n"))
    x = F.col(value)
    take = lambda i: F.when(F.col(f"_{i}") < x, F.col(f"_{i}")).otherwise(F.col(f"_{i + 1}"))
    out = df.withColumn("g_", F.struct(*group)).join(middle.withColumnRenamed("g", "g_"), "g_", "left")
    return out.withColumn(name, F.when((F.col("_n") > 1) & x.isNotNull(), (take(0) + take(2)) / 2)).drop("g_", "_0", "_1", "_2", "_3", "_n")


def smooth(df: DataFrame, value: str, size_km: float, sigma_km: float, reach: int = 3) -> DataFrame:
    """cx, cy, mean: the Gaussian-weighted geometric mean of value around each cell that has rows, in two passes along the axes over cell sums."""
    x, y = plane_km(F.col("lat"), F.col("lon"))
    cells = df.groupBy(cell(x, size_km).alias("cx"), cell(y, size_km).alias("cy")).agg(F.sum(F.log(value)).alias("s"), F.count("*").cast("double").alias("n"))
    out = cells.select("cx", "cy", "s", "n")
    for axis, other in (("cx", "cy"), ("cy", "cx")):
        spread = out.withColumn("d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(axis, F.col(axis) + F.col("d"))
        weight = F.exp(-F.pow(F.col("d") * size_km / sigma_km, 2) / 2)
        out = spread.groupBy(axis, other).agg(F.sum(F.col("s") * weight).alias("s"), F.sum(F.col("n") * weight).alias("n"))
    return out.join(cells.select("cx", "cy"), ["cx", "cy"], "left_semi").select("cx", "cy", F.exp(F.col("s") / F.col("n")).alias("mean"))


def location_tree(df: DataFrame) -> DataFrame:
    """district and its wards, sorted."""
    return df.where("district IS NOT NULL AND ward IS NOT NULL").groupBy("district").agg(F.sort_array(F.collect_set("ward")).alias("wards"))

