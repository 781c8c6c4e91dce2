"""Registered queries of valuations, neighbours, comparables, the place cascade and searches by all conditions, beside the same rows in DuckDB SQL where that can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import appraisal, market, search, valuation
from hearthline.plans.registry import query, rounded
from hearthline.plans.views import LISTING, PLACES, km_sql, listing, places

NUMBERS, GROUPS = ["area", "rooms", "lat", "lon"], {"lat": "place", "lon": "place", "lat_missing": "place", "lon_missing": "place", "area_missing": "area", "rooms_missing": "rooms", "enc_ward": "ward"}


def _homes(spark: SparkSession, d: str) -> DataFrame:
    """Places with sizes, rooms (some unknown) and a price that follows them."""
    area, rooms = (20 + F.col("row_id") % 180).cast("double"), F.when(F.col("row_id") % 7 != 0, (1 + F.col("row_id") % 5).cast("int"))
    rows = places(spark, d).withColumn("area", area).withColumn("rooms", rooms)
    return rows.withColumn("price", F.col("area") * (30 + 5 * F.col("ward") + 40 * (F.col("lat") - 20.5)) * (1 + (F.col("row_id") % 13) / 50))


@query()
def valuations(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth home as a request, some without a pin or a size, valued from all: price, interval, grade, reasons and comparables."""
    homes = _homes(spark, d)
    blank = lambda c, n: F.when(F.col("row_id") % n != 0, F.col(c)).alias(c)
    asked = homes.where("row_id % 50 = 0").select("row_id", blank("area", 300), "rooms", "ward", "district", blank("lat", 100), blank("lon", 100))
    rest = homes.where("row_id % 50 <> 0")
    out = appraisal.appraise(valuation.fit(rest, NUMBERS, ["ward"]), rest, asked, [("ward", ["district", "ward"]), ("district", ["district"])], GROUPS)
    return out.withColumn("reasons", F.to_json("reasons")).withColumn("alike", F.array_join("alike", ","))


@query()
def input_importance(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute shares of the inputs of boosted trees, over all homes."""
    homes = _homes(spark, d)
    appraiser = valuation.fit(homes, NUMBERS, ["ward"])
    return appraisal.importance(appraiser.features(homes), appraisal.leaves(appraiser.model, appraiser.train), appraiser.inputs)


@query()
def interval_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A fixed band, forest quantiles and conformal quantiles of all homes, each of three folds from the others."""
    return appraisal.compare_intervals(appraisal.interval_rows(_homes(spark, d), NUMBERS, ["ward"], folds=3))


@query(f"""WITH {PLACES}, n AS (SELECT a.row_id, b.price, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km, b.row_id AS other FROM places a JOIN places b ON a.row_id <> b.row_id),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY km, other) AS rank FROM n), g AS (SELECT row_id, count(*) FILTER (km <= 1.0) AS around,
exp(median(ln(price)) FILTER (rank <= 5)) AS near_5, max(km) FILTER (rank <= 5) AS km_5, exp(median(ln(price)) FILTER (rank <= 15)) AS near_15, max(km) FILTER (rank <= 15) AS km_15 FROM r GROUP BY row_id)
SELECT row_id, around, round(near_5, 2) AS near_5, round(km_5, 4) AS km_5, round(near_15, 2) AS near_15, round(km_15, 4) AS km_15 FROM g""")
def neighbour_prices(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    out = appraisal.neighbour_prices(p, p, (5, 15), "price")
    return out.select("row_id", "around", *(F.round(c, 2 if c.startswith("near") else 4).alias(c) for c in ("near_5", "km_5", "near_15", "km_15")))


@query(f"""WITH {LISTING}, q AS (SELECT * FROM listing WHERE row_id % 50 = 0), w AS (SELECT ward, count(*) AS n FROM listing GROUP BY ward),
c AS (SELECT q.row_id AS request, l.row_id, abs(l.area - q.area) / q.area AS area_gap, coalesce(abs(l.rooms - q.rooms), 9) AS room_gap FROM q JOIN w USING (ward) JOIN listing l ON CASE WHEN w.n >= 10 THEN l.ward = q.ward ELSE l.district = q.district END),
r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY area_gap, room_gap, row_id)::INT AS rank FROM c) SELECT request, row_id, rank FROM r WHERE rank <= 10""")
def request_comparables(spark: SparkSession, d: str) -> DataFrame:
    """The ten listings most like each fiftieth one, itself among them."""
    rows = listing(spark, d)
    return appraisal.comparables_of(rows.where("row_id % 50 = 0"), rows, 10).select("request", "row_id", "rank")


#: The keys of the second source, and those of the rows looked up in it: by the row's last digit these lack what finer levels need, so that every level is reached; a street of -1 is known nowhere.
_KEYS = {"ward": "ward", "district": "district", "project": "row_id % 11", "street": "row_id % 17", "new_ward": "ward % 4", "listing": "row_id"}
_ASKED = {
    "ward": "CASE WHEN row_id % 10 NOT IN (4, 5, 6, 7) THEN ward END", "district": "CASE WHEN row_id % 10 <> 8 THEN district END", "project": "CASE WHEN row_id % 10 < 2 THEN row_id % 11 END",
    "street": "CASE WHEN row_id % 10 IN (2, 4, 6) THEN row_id % 17 ELSE -1 END", "new_ward": "CASE WHEN row_id % 10 IN (4, 5) THEN ward % 4 END", "listing": "CASE WHEN row_id % 10 = 0 THEN row_id END",
}
_AUDITED = _ASKED | {"listing": "row_id"}
_keyed_sql = lambda keys: ", ".join(f"{e} AS {c}" for c, e in keys.items())
_SQL_LEVELS = [("id", ["listing"]), *market.LEVELS]


def _cascade_sql(audit: bool = False) -> str:
    """Levels as CTEs of medians by key, joined in order; for an audit without own pins and ids, beside the place of the id."""
    tables = [f"t{i} AS (SELECT {', '.join(k)}, {'min' if name == 'id' else 'median'}(lat) AS la, {'min' if name == 'id' else 'median'}(lon) AS lo, count(*) AS n FROM ref WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} GROUP BY ALL)" for i, (name, k) in enumerate(_SQL_LEVELS)]
    joins = " ".join(f"{'JOIN' if audit and name == 'id' else 'LEFT JOIN'} t{i} ON {' AND '.join(f't{i}.{c} = o.{c}' for c in k)}" for i, (name, k) in enumerate(_SQL_LEVELS))
    used = list(enumerate(_SQL_LEVELS))[1 if audit else 0 :]
    pick = lambda c: "coalesce(" + ", ".join(f"t{i}.{c}" for i, _ in used) + ")"
    level = " ".join(f"WHEN t{i}.n IS NOT NULL THEN '{name}'" for i, (name, _) in used)
    own = "FALSE" if audit else f"row_id % 10 = 9 AND lat BETWEEN 20.53 AND 21.39 AND lon BETWEEN 105.28 AND 106.03 AND {km_sql('lat', 'lon', '21.02895', '105.85245')} >= 0.03"
    return f"""WITH {PLACES}, k AS (SELECT row_id, lat, lon, {_keyed_sql(_AUDITED if audit else _ASKED)} FROM places), ref AS (SELECT row_id, lat, lon, {_keyed_sql(_KEYS)} FROM places), o AS (SELECT *, {own} AS own FROM k), {', '.join(tables)}
SELECT row_id, CASE WHEN own THEN 'own' {level} END AS level, CASE WHEN NOT own THEN {pick('n')} END AS support, CASE WHEN own THEN o.lat ELSE {pick('la')} END AS lat, CASE WHEN own THEN o.lon ELSE {pick('lo')} END AS lon
{', t0.la AS tla, t0.lo AS tlo' if audit else ''} FROM o {joins}"""


def _keyed(spark: SparkSession, d: str, keys: dict[str, str]) -> DataFrame:
    return places(spark, d).select("row_id", "lat", "lon", *(F.expr(e).alias(c) for c, e in keys.items()))


@query(f"SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM ({_cascade_sql()})")
def assigned_places(spark: SparkSession, d: str) -> DataFrame:
    """All nine levels and none: the places are a second source that they are looked up in by the keys they have left; a tenth has its own pin."""
    asked = _keyed(spark, d, _ASKED).withColumns({c: F.when(F.col("row_id") % 10 == 9, F.col(c)) for c in ("lat", "lon")})
    out = market.assign_places(asked, _keyed(spark, d, _KEYS), listing_id="listing")
    return rounded(out.select("row_id", "level", "support", "lat", "lon"), 6)


@query(f"""WITH x AS ({_cascade_sql(audit=True)}), e AS (SELECT level, {km_sql('lat', 'lon', 'tla', 'tlo')} AS km FROM x WHERE level IS NOT NULL)
SELECT level, count(*) AS n, round(median(km), 4) AS q50, round(quantile_cont(km, 0.9), 4) AS q90, round(avg((km <= 0.5)::INT), 4) AS within_500m, round(avg((km <= 1)::INT), 4) AS within_1km, round(avg((km <= 2)::INT), 4) AS within_2km FROM e GROUP BY level""")
def place_audit(spark: SparkSession, d: str) -> DataFrame:
    """How far looked-up places are from those of the listings' ids, by each of the seven levels of names."""
    return rounded(market.audit_places(_keyed(spark, d, _AUDITED), _keyed(spark, d, _KEYS), "listing"))


_MORE = {
    "ppm2": "price / area", "project": "CASE WHEN row_id % 3 = 0 THEN concat('P', row_id % 50) END", "street": "concat('S', row_id % 8)", "baths": "CAST(1 + row_id % 3 AS INT)",
    "floor": "CASE WHEN row_id % 4 <> 0 THEN CAST(row_id % 30 AS INT) END", "frontage": "CASE WHEN row_id % 5 <> 0 THEN CAST(row_id % 12 AS DOUBLE) END", "road": "CAST(row_id % 20 AS DOUBLE)",
    "centre_km": "CAST(row_id % 25 AS DOUBLE)", "papers": "segment", "door_facing": "CASE WHEN row_id % 6 <> 0 THEN concat('F', row_id % 8) END", "balcony_facing": "CASE WHEN row_id % 2 = 0 THEN concat('F', row_id % 5) END",
    "furniture": "CASE WHEN row_id % 7 <> 0 THEN concat('N', row_id % 3) END", "has_pool": "CASE WHEN row_id % 3 <> 0 THEN CAST(row_id % 2 AS INT) END", "has_noise": "CAST(row_id % 4 = 0 AS INT)",
}
REQUEST = {
    "project": "none such", "street": "S99", "ward": "nowhere", "district": "ASIA", "kind": "1-URGENT", "not_kinds": ["5-LOW"], "price_from": 20_000, "price_to": 300_000, "ppm2_from": 100, "ppm2_to": 90_000,
    "area_from": 30, "area_to": 190, "rooms": 9, "baths": 2, "floor": (2, None), "frontage_from": 2, "road_from": 1, "centre_to": 24, "papers": ["BUILDING", "MACHINERY", "FURNITURE"], "facing": ["F1", "F3", "F5", "F7"],
    "door_facing": ["F9"], "balcony_facing": ["F9"], "not_facing": ["F2"], "furniture": ["N0", "N1"], "with": ["has_pool"], "without": ["has_noise"],
}
_TESTS = [
    ("project", "project = 'none such'"), ("street", "street = 'S99'"), ("ward", "ward = 'nowhere'"), ("district", "district = 'ASIA'"), ("kind", "kind = '1-URGENT'"), ("not_kinds", "NOT coalesce(kind = '5-LOW', FALSE)"),
    ("price_from", "price >= 20000"), ("price_to", "price <= 300000"), ("ppm2_from", "ppm2 >= 100"), ("ppm2_to", "ppm2 <= 90000"), ("area_from", "area >= 30"), ("area_to", "area <= 190"), ("rooms", "rooms = 9"),
    ("baths", "baths = 2"), ("floor", "floor >= 2"), ("frontage_from", "frontage >= 2"), ("road_from", "road >= 1"), ("centre_to", "centre_km <= 24"), ("papers", "papers IN ('BUILDING', 'MACHINERY', 'FURNITURE')"),
    ("facing", "coalesce(door_facing IN ('F1', 'F3', 'F5', 'F7'), FALSE) OR coalesce(balcony_facing IN ('F1', 'F3', 'F5', 'F7'), FALSE)"), ("door_facing", "door_facing = 'F9'"), ("balcony_facing", "balcony_facing = 'F9'"),
    ("not_facing", "NOT coalesce(door_facing = 'F2', FALSE) AND NOT coalesce(balcony_facing = 'F2', FALSE)"), ("furniture", "furniture IN ('N0', 'N1')"), ("has_pool", "coalesce(has_pool > 0, FALSE)"), ("has_noise", "NOT coalesce(has_noise > 0, FALSE)"),
]
_STEPS = ["m0 AS (SELECT *, TRUE AS ok, '' AS skipped FROM more)"]
for _i, (_name, _test) in enumerate(_TESTS):
    _tested = f"SELECT *, coalesce({_test}, FALSE) AS met, bool_or(ok AND coalesce({_test}, FALSE)) OVER () AS possible FROM m{_i}"
    _STEPS.append(f"m{_i + 1} AS (SELECT * EXCLUDE (met, possible) REPLACE (ok AND (met OR NOT possible) AS ok, concat(skipped, CASE WHEN NOT possible THEN '{_name} ' END) AS skipped) FROM ({_tested}))")


@query(f"WITH {LISTING}, more AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _MORE.items())} FROM listing), {', '.join(_STEPS)} SELECT row_id, trim(skipped) AS skipped FROM m{len(_TESTS)} WHERE ok")
def search_by_all(spark: SparkSession, d: str) -> DataFrame:
    """All conditions at once, with the names of those that had to be skipped."""
    rows = listing(spark, d).select("*", *(F.expr(e).alias(c) for c, e in _MORE.items()))
    found, skipped = search.find(rows, REQUEST)
    return found.select("row_id", F.lit(" ".join(skipped)).alias("skipped"))
