"""Price surfaces and their bands: moments of log prices smoothed by each row's own positional error, and polygons between levels, put together in Spark rounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.geo import DEGREE_KM, PLANE_LATITUDE, cell, plane_km
from hearthline.operators.lineage import cut_lineage
from hearthline.operators.quantiles import exact_quantiles

#: The least width of a kernel in kilometres, that of an unknown error, the kernel's reach in widths, and the share of the thinnest cells that is masked.
LEAST_SIGMA, UNKNOWN_SIGMA, REACH, THIN = 0.30, 0.79, 4.0, 0.18


def price_surface(df: DataFrame, value: str, size_km: float, error_km: Column, thin: float = THIN) -> DataFrame:
    """cx, cy, n, mean, dispersion and dense per cell that a kernel reaches.

    Rows with equal error share a Gaussian of that width (not below LEAST_SIGMA; UNKNOWN_SIGMA where it is null), cut at REACH widths and with weights that sum to 1. Number, sum and sum of squares of log values are
    smoothed along one axis and then the other, per error, and added: mean = exp(sum / n), dispersion = exp(standard deviation) - 1. dense: n (to nine decimals) is not below its exact ``thin`` quantile over all cells. Rows
    without a place or a positive value take no part. What is shuffled grows with cells times errors times reach, not with rows.
    """
    x, y = plane_km(F.col("lat"), F.col("lon"))
    sigma = F.greatest(F.coalesce(error_km, F.lit(UNKNOWN_SIGMA)), F.lit(LEAST_SIGMA))
    known = df.where("lat IS NOT NULL AND lon IS NOT NULL").where(F.col(value) > 0)
    log = F.log(F.col(value))
    out = known.groupBy(sigma.alias("sigma"), cell(x, size_km).alias("cx"), cell(y, size_km).alias("cy")).agg(F.count("*").cast("double").alias("n"), F.sum(log).alias("s"), F.sum(log * log).alias("ss"))
    width = F.col("sigma") / size_km
    reach = F.floor(width * REACH + 0.5)
    bell = lambda d: F.exp(-F.pow(d / width, 2) / 2)
    total = F.aggregate(F.sequence(-reach, reach), F.lit(0.0), lambda a, d: a + bell(d))
    for axis, other in (("cx", "cy"), ("cy", "cx")):
        spread = out.withColumn("_all", total).withColumn("d", F.explode(F.sequence(-reach, reach)))
        weight = bell(F.col("d")) / F.col("_all")
        spread = spread.select("sigma", (F.col(axis) + F.col("d")).alias(axis), other, *((F.col(c) * weight).alias(c) for c in ("n", "s", "ss")))
        out = spread.groupBy("sigma", axis, other).agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    cells = out.groupBy("cx", "cy").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    cells = cut_lineage(cells.select("cx", "cy", F.round("n", 9).alias("n"), F.exp(mean).alias("mean"), (F.exp(spread) - 1).alias("dispersion")).where("n > 0"))
    least = exact_quantiles(cells, [], "n", {"_least": thin}).select("_least")
    return cells.join(F.broadcast(least)).withColumn("dense", F.col("n") >= F.col("_least")).drop("_least")


def levels_between(cells: DataFrame, value: str, bands: int, low: float = 0.1, high: float = 0.9) -> list[float]:
    """bands + 1 levels at equal steps between two exact quantiles of the cells' values; none if there are no values."""
    ends = exact_quantiles(cells, [], value, {"low": low, "high": high}).first()
    return [] if ends["n"] == 0 else [ends["low"] + (ends["high"] - ends["low"]) * i / bands for i in range(bands + 1)]


def band_of(value: Column, levels: list[float]) -> Column:
    """How many of the levels are not above the value: 0 below the first, len(levels) from the last on."""
    if not levels:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, levels)), lambda x: x <= value))


def _borders(cells: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """Directed edges (id, band, ax, ay, bx, by) around every band, its inside on the left, in units of cells.

    Four neighbouring cells make a square, which its centre (the mean of the four) parts into triangles; a band's share of a triangle is a
    convex polygon between two levels. Edges that two polygons of a band share run both ways and cancel out; crossings are computed from the same end
    whichever triangle asks, so both have the same numbers.
    """
    point = lambda x, y, v: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), v.alias("v"))
    corners = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)))
    at = cells.where(F.col(value).isNotNull()).select("cx", "cy", F.col(value).cast("double").alias("v"), F.explode(corners).alias("d"))
    at = at.select((F.col("cx") - F.col("d.dx")).alias("x"), (F.col("cy") - F.col("d.dy")).alias("y"), "d", "v")
    corner = lambda dx, dy: F.max(F.when((F.col("d.dx") == dx) & (F.col("d.dy") == dy), F.col("v"))).alias(f"v{dx}{dy}")
    squares = at.groupBy("x", "y").agg(F.count("*").alias("k"), *(corner(dx, dy) for dx in (0, 1) for dy in (0, 1))).where("k = 4")
    c, ring = F.col, ((0, 0), (1, 0), (1, 1), (0, 1))
    p = [point(c("x") + dx, c("y") + dy, c(f"v{dx}{dy}")) for dx, dy in ring]
    middle = point(c("x") + 0.5, c("y") + 0.5, (c("v00") + c("v10") + c("v11") + c("v01")) / 4)
    whole = band_of(F.least(*(q["v"] for q in p)), levels) == band_of(F.greatest(*(q["v"] for q in p)), levels)
    shapes = F.when(whole, F.array(F.array(*p))).otherwise(F.array(*(F.array(p[i], p[(i + 1) % 4], middle) for i in range(4))))
    shapes = squares.select(F.explode(shapes).alias("p"))
    values = F.transform("p", lambda q: q["v"])
    shapes = shapes.withColumn("band", F.explode(F.sequence(band_of(F.array_min(values), levels), band_of(F.array_max(values), levels))))
    ends = F.array(*map(F.lit, [-math.inf, *levels, math.inf]))
    low, high = F.get(ends, c("band")), F.get(ends, c("band") + 1)

    def crossing(a: Column, b: Column, level: Column) -> Column:
        first, last = F.least(a, b), F.greatest(a, b)  # by x, then y
        t = (level - first["v"]) / (last["v"] - first["v"])
        return F.when((a["v"] < level) != (b["v"] < level), F.struct((first["x"] + t * (last["x"] - first["x"])).alias("x"), (first["y"] + t * (last["y"] - first["y"])).alias("y")))

    def side(i: Column) -> Column:
        a, b = F.get("p", i), F.get("p", (i + 1) % F.size("p"))
        own = F.when((a["v"] >= low) & (a["v"] < high), F.struct(a["x"].alias("x"), a["y"].alias("y")))
        up, down = crossing(a, b, low), crossing(a, b, high)
        return F.when(a["v"] < b["v"], F.array(own, up, down)).otherwise(F.array(own, down, up))

    round_ = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - 1), side)), lambda q: q.isNotNull())
    clipped = shapes.select("band", round_.alias("q")).where(F.size("q") > 2)
    edges = F.transform(F.sequence(F.lit(0), F.size("q") - 1), lambda i: F.struct(F.get("q", i).alias("a"), F.get("q", (i + 1) % F.size("q")).alias("b")))
    edges = clipped.select("band", F.inline(edges)).where("a <> b")
    run = edges.groupBy("band", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("w")).agg(F.sum(F.when(c("a") < c("b"), 1).otherwise(-1)).alias("way")).where("way <> 0")
    a, b = (F.when((c("way") > 0) == first, c("u")).otherwise(c("w")) for first in (True, False))
    run = run.select("band", a.alias("a"), b.alias("b"))
    return cut_lineage(run.select(F.monotonically_increasing_id().alias("id"), "band", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")))


def rings(following: DataFrame) -> DataFrame:
    """(id, ring, place) from (id, next), where next leads round in circles: ring is the smallest id of the circle, place the steps from the id to it.

    Each round looks twice as far ahead; it ends when no id sees a smaller one than before, after as many rounds as the longest circle has binary digits.
    """
    now, far = cut_lineage(following.select("id", F.col("next").alias("jump"), F.col("id").alias("ring"), F.lit(0).cast("long").alias("place"))), 1
    while True:
        ahead = now.select(F.col("id").alias("jump"), F.col("jump").alias("jump_"), F.col("ring").alias("ring_"), F.col("place").alias("place_"))
        less = F.col("ring_") < F.col("ring")
        place = F.when(less, F.col("place_") + far).otherwise(F.col("place"))
        now = cut_lineage(now.join(ahead, "jump").select("id", F.col("jump_").alias("jump"), F.least("ring", "ring_").alias("ring"), place.alias("place"), less.alias("new")))
        far *= 2
        if now.where("new").isEmpty():
            return now.select("id", "ring", "place")


def iso_bands(cells: DataFrame, value: str, levels: list[float]) -> DataFrame:
    """band, outer (its number), area and rings per polygon of each band, from cells (cx, cy, value) and ascending levels; band as band_of() says.

    Places are in units of cells, a cell's value standing at its whole coordinates; the area is in square cells. rings holds the outer ring, counter-clockwise, then the holes, clockwise; every ring is closed. Between cells the
    value is linear over four triangles a square; a square that lacks a corner is in no band. Two parts of a band that touch in a point stay apart; a part that touches itself in a point has a ring that runs through it twice. Edges are joined end to
    start, and rings are named and put in order in rounds (see rings()). A hole belongs to the ring that bounds its band to the left of its leftmost point, or to that ring's owner if it is a hole itself.
    """
    if sorted(set(levels)) != list(levels):
        raise ValueError("levels have to ascend")
    c = F.col
    edges = _borders(cells, value, levels)
    after = edges.select(c("id").alias("next"), "band", c("ax").alias("bx"), c("ay").alias("by"), c("bx").alias("ex"), c("by").alias("ey"))
    back, ahead = F.atan2(c("ay") - c("by"), c("ax") - c("bx")), F.atan2(c("ey") - c("by"), c("ex") - c("bx"))
    turn = F.pmod(back - ahead, F.lit(2 * math.pi))
    # at most a few edges leave a point: the first one clockwise from where an edge comes from keeps the same part of the band on the left
    following = edges.join(after, ["band", "bx", "by"]).groupBy("id").agg(F.min_by("next", F.when(turn < 1e-12, turn + 2 * math.pi).otherwise(turn)).alias("next"))
    named = cut_lineage(edges.join(rings(following), "id"))
    corner = F.struct("ax", "ay")
    shape = F.sort_array(F.collect_list(F.struct(c("place").alias("place"), c("ax").alias("x"), c("ay").alias("y"))), asc=False)
    made = named.groupBy("band", "ring").agg((F.sum(c("ax") * c("by") - c("bx") * c("ay")) / 2).alias("area"), F.min(corner).alias("left"), shape.alias("p"))
    made = made.withColumn("p", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))
    made = cut_lineage(made.withColumn("p", F.concat("p", F.slice("p", 1, 1))))
    holes = made.where("area < 0").select("band", c("ring").alias("hole"), c("left.ax").alias("x0"), c("left.ay").alias("y0"), F.floor("left.ay").alias("row"))
    crossed = named.select("band", F.floor(F.least("ay", "by")).alias("row"), "ring", "ax", "ay", "bx", "by")  # an edge lies between two rows of cells
    at = c("ax") + (c("y0") - c("ay")) * (c("bx") - c("ax")) / (c("by") - c("ay"))
    met = holes.join(crossed, ["band", "row"]).where((c("ay") > c("y0")) != (c("by") > c("y0"))).withColumn("at", at).where(c("at") < c("x0"))
    owner = cut_lineage(met.groupBy("hole").agg(F.max_by("ring", "at").alias("owner")))
    while True:  # a hole beside a hole: on to that one's owner, twice as far each round
        on = owner.select(c("hole").alias("owner"), c("owner").alias("on"))
        owner = cut_lineage(owner.join(on, "owner", "left").select("hole", F.coalesce("on", "owner").alias("owner"), c("on").isNotNull().alias("moved")))
        if owner.where("moved").isEmpty():
            break
    owned = made.join(owner.select(c("hole").alias("ring"), "owner"), "ring", "left")
    grouped = owned.groupBy("band", F.coalesce("owner", "ring").alias("outer")).agg(F.sum("area").alias("area"), F.sort_array(F.collect_list(F.struct((c("area") < 0).alias("hole"), c("ring").alias("ring"), c("p").alias("p")))).alias("r"))
    return grouped.select("band", "outer", "area", F.transform("r", lambda x: x["p"]).alias("rings"))


def in_degrees(rings_: Column, size_km: float) -> Column:
    """Rings of cells' middles as rings of [longitude, latitude], as GeoJSON wants them."""
    east = size_km / (DEGREE_KM * math.cos(math.radians(PLANE_LATITUDE)))
    return F.transform(rings_, lambda r: F.transform(r, lambda q: F.array((q["x"] + 0.5) * east, (q["y"] + 0.5) * (size_km / DEGREE_KM))))


def band_features(bands: DataFrame, levels: list[float], size_km: float) -> DataFrame:
    """band, low, high (null where open) and geometry, a GeoJSON polygon as text."""
    ends = F.array(F.lit(None).cast("double"), *map(F.lit, levels), F.lit(None).cast("double"))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), in_degrees(F.col("rings"), size_km).alias("coordinates")))
    return bands.select("band", F.get(ends, F.col("band")).alias("low"), F.get(ends, F.col("band") + 1).alias("high"), shape.alias("geometry"))
