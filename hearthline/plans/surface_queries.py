"""Queries of price surfaces and their bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import surface
from hearthline.plans.registry import query, rounded
from hearthline.plans.views import PLACES, places

SIZE, BANDS = 4.0, 5

SURFACE = f"""
k AS (SELECT ward, lat, lon, ln(price) AS v, CASE row_id % 4 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.79::DOUBLE END / {SIZE} AS w FROM places WHERE lat IS NOT NULL AND lon IS NOT NULL),
b AS (SELECT w, floor(lon * (111.32::DOUBLE * cos(radians(21.0::DOUBLE))) / {SIZE})::BIGINT AS cx, floor(lat * 111.32::DOUBLE / {SIZE})::BIGINT AS cy, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM k GROUP BY ALL),
r AS (SELECT w, unnest(range(-floor(w * 4 + 0.5)::BIGINT, floor(w * 4 + 0.5)::BIGINT + 1)) AS d FROM (SELECT DISTINCT w FROM b)),
g AS (SELECT w, d, exp(-pow(d / w, 2) / 2) / sum(exp(-pow(d / w, 2) / 2)) OVER (PARTITION BY w) AS e FROM r),
m AS (SELECT cx + i.d AS cx, cy + j.d AS cy, sum(n * i.e * j.e) AS n, sum(s * i.e * j.e) AS s, sum(ss * i.e * j.e) AS ss FROM b JOIN g i ON i.w = b.w JOIN g j ON j.w = b.w GROUP BY 1, 2),
u AS (SELECT cx, cy, round(n, 9) AS n, exp(s / n) AS mean, exp(sqrt(greatest(ss / n - pow(s / n, 2), 0))) - 1 AS dispersion FROM m WHERE round(n, 9) > 0),
f AS (SELECT u.*, n >= (SELECT quantile_cont(n, 0.18) FROM u) AS dense FROM u)"""


def _surface(spark: SparkSession, d: str) -> DataFrame:
    errors = F.when(F.col("row_id") % 4 == 0, 3.0).when(F.col("row_id") % 4 == 1, 5.0).when(F.col("row_id") % 4 == 2, 0.1)
    return surface.price_surface(places(spark, d), "price", SIZE, errors)


@query(f"WITH {PLACES}, {SURFACE} SELECT cx, cy, round(n, 6) AS n, round(mean, 2) AS mean, round(dispersion, 6) AS dispersion, dense FROM f")
def full_surface(spark: SparkSession, d: str) -> DataFrame:
    """The smoothed surface: three positional errors and an unknown one, mean, dispersion and the mask of thin cells."""
    return _surface(spark, d).select("cx", "cy", F.round("n", 6).alias("n"), F.round("mean", 2).alias("mean"), F.round("dispersion", 6).alias("dispersion"), "dense")


@query(f"""WITH {PLACES}, {SURFACE},
e AS (SELECT quantile_cont(mean, 0.1) AS lo, quantile_cont(mean, 0.9) AS hi FROM f WHERE dense), l AS (SELECT i, lo + (hi - lo) * i / {BANDS} AS level FROM e, range({BANDS + 1}) x(i)),
c AS (SELECT (SELECT count(*) FROM l WHERE level <= mean) AS band, count(*) AS cells FROM f WHERE dense GROUP BY 1),
q AS (SELECT a.mean AS v0, b.mean AS v1, c.mean AS v2, d.mean AS v3 FROM f a JOIN f b ON b.cx = a.cx + 1 AND b.cy = a.cy JOIN f c ON c.cx = a.cx + 1 AND c.cy = a.cy + 1 JOIN f d ON d.cx = a.cx AND d.cy = a.cy + 1
      WHERE a.dense AND b.dense AND c.dense AND d.dense),
t AS (SELECT list_sort([x, y, (v0 + v1 + v2 + v3) / 4]) AS v FROM (SELECT *, v0 AS x, v1 AS y FROM q UNION ALL SELECT *, v1, v2 FROM q UNION ALL SELECT *, v2, v3 FROM q UNION ALL SELECT *, v3, v0 FROM q)),
a AS (SELECT i, sum(CASE WHEN level <= v[1] THEN 0 WHEN level >= v[3] THEN 1 WHEN level <= v[2] THEN pow(level - v[1], 2) / ((v[2] - v[1]) * (v[3] - v[1]))
      ELSE 1 - pow(v[3] - level, 2) / ((v[3] - v[1]) * (v[3] - v[2])) END) * {SIZE * SIZE / 4} AS below, count(*) * {SIZE * SIZE / 4} AS whole FROM t, l GROUP BY i),
s AS (SELECT i AS band, below - coalesce(lag(below) OVER (ORDER BY i), 0) AS area FROM a UNION ALL SELECT {BANDS + 1}, whole - below FROM a WHERE i = {BANDS})
SELECT band::INT AS band, coalesce(cells, 0) AS cells, round(coalesce(area, 0), 4) AS area FROM c FULL JOIN s USING (band) WHERE coalesce(cells, 0) > 0 OR area > 1e-9""")
def price_bands(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of the surface between equal steps of price: cells and square kilometres per band, the area summed over the rings."""
    cells = _surface(spark, d).where("dense")
    levels = surface.levels_between(cells, "mean", BANDS)
    counted = cells.groupBy(surface.band_of(F.col("mean"), levels).alias("band")).agg(F.count("*").alias("cells"))
    areas = surface.iso_bands(cells, "mean", levels).groupBy("band").agg((F.sum("area") * SIZE * SIZE).alias("area")).where("area > 1e-9")
    return rounded(counted.join(areas, "band", "full").select("band", F.coalesce("cells", F.lit(0).cast("long")).alias("cells"), F.coalesce("area", F.lit(0.0)).alias("area")))
