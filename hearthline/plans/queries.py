"""The registered queries: each applies an operator to the given tables, beside the same rows in DuckDB SQL where that can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.functions import geo, text
from hearthline.operators import areas, quality, quantiles, search, valuation
from hearthline.plans.registry import QUERIES, SQL, query, rounded as _round
from hearthline.plans.views import LISTING, PLACES, km_sql, listing, places, spread, table
from hearthline.sources import files, html
from hearthline.streaming import sightings

# Quality


@query(f"WITH {LISTING} SELECT row_id, ward, kind, price FROM listing QUALIFY row_number() OVER (PARTITION BY ward, kind, area, floor(price / 1e5) ORDER BY row_id) = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return quality.keep_first(listing(spark, d), ["ward", "kind", "area", F.floor(F.col("price") / 1e5)]).select("row_id", "ward", "kind", "price")


@query(f"WITH {LISTING} SELECT owner, row_id, price FROM listing QUALIFY row_number() OVER (PARTITION BY owner ORDER BY (rooms IS NOT NULL) DESC, row_id) = 1")
def collapse_prefer(spark: SparkSession, d: str) -> DataFrame:
    return quality.prefer_first(listing(spark, d), "owner", F.col("rooms").isNotNull()).select("owner", "row_id", "price")


@query(f"""WITH {LISTING}, q AS (SELECT *, quantile_cont(price / area, 0.25) OVER w AS q1, quantile_cont(price / area, 0.75) OVER w AS q3, count(*) OVER w AS n FROM listing WINDOW w AS (PARTITION BY ward, kind))
SELECT row_id, n >= 15 AND (price / area < q1 - 1.5 * (q3 - q1) OR price / area > q3 + 1.5 * (q3 - q1)) AS outlier FROM q""")
def iqr_outliers(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.with_iqr_outlier(listing(spark, d), F.col("price") / F.col("area"), ["ward", "kind"], k=1.5).select("row_id", "outlier")


BROKEN = "CASE WHEN row_id % 50 = 0 THEN price * 1000 WHEN row_id % 50 = 1 THEN price / 1000 ELSE price END"


@query(f"""WITH {LISTING}, l AS (SELECT * REPLACE ({BROKEN} AS price) FROM listing),
b AS (SELECT CASE WHEN count(*) >= 50 THEN quantile_cont(price / area, 0.01) ELSE 50 END AS lo, CASE WHEN count(*) >= 50 THEN quantile_cont(price / area, 0.99) ELSE 20000 END AS hi FROM l WHERE price / area BETWEEN 50 AND 20000),
f AS (SELECT row_id, price, CASE WHEN price / area > 20000 AND price / area / 1000 BETWEEN lo AND hi THEN '/1000' WHEN price / area < 50 AND price / area * 1000 BETWEEN lo AND hi THEN '*1000' END AS fix FROM l, b)
SELECT row_id, fix, round(CASE fix WHEN '/1000' THEN price / 1000 WHEN '*1000' THEN price * 1000 ELSE price END, 2) AS price_fixed FROM f""")
def unit_repair(spark: SparkSession, d: str) -> DataFrame:
    broken = listing(spark, d).withColumn("price", F.expr(BROKEN))
    band = quality.plausible_band(broken, F.col("price") / F.col("area"), 50, 20000)
    return _round(quality.repair_units(broken, band, 50, 20000).select("row_id", "fix", "price_fixed"), 2)


STEPS = {"no rooms": "rooms IS NULL", "small": "area < 40", "dear": "price > 400000", "old": "seen < TIMESTAMP '1993-01-01'"}


@query(f"""WITH {LISTING}, r AS (SELECT CASE {' '.join(f"WHEN {c} THEN '{s}'" for s, c in STEPS.items())} END AS reason FROM listing),
s AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(STEPS))}) v(step, place)), c AS (SELECT step, place, (SELECT count(*) FROM r WHERE reason = step) AS removed FROM s),
t AS (SELECT step, place, (SELECT count(*) FROM r) - coalesce(sum(removed) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_in, removed FROM c)
SELECT step, place::INT AS place, rows_in::BIGINT AS rows_in, removed, (rows_in - removed)::BIGINT AS kept, round(100.0::DOUBLE * removed / rows_in, 2) AS percent FROM t""")
def cleaning_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).select(quality.reject_reason([(s, F.expr(c)) for s, c in STEPS.items()]).alias("reason"))
    return quality.ledger(rows, list(STEPS))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings, arg_max(props, (ts, props)) AS latest FROM events GROUP BY user_id")
def sightings_upsert(spark: SparkSession, d: str) -> DataFrame:
    return quality.upsert(table(spark, d, "events"), "user_id", "ts", "props")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return quality.pending(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query()
def similar_texts(spark: SparkSession, d: str) -> DataFrame:
    """Greedy TF-IDF leaders of conversation turns, in blocks of role and the text's length to ten characters."""
    turns = spread(table(spark, d, "conversations"), "conv_id").withColumn("row_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).withColumn("about", F.floor(F.length("text") / 10))
    return quality.similar_leaders(turns, ["role", "about"], "text")


@query("SELECT 'order' AS source, o_orderkey AS row_id, o_totalprice AS price, NULL::VARCHAR AS brand FROM orders UNION ALL SELECT 'part', p_partkey, p_retailprice, p_brand FROM part")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    return quality.union_sources({"order": orders, "part": part}).select("source", "row_id", "price", "brand")


# Areas


@query(f"WITH {LISTING} SELECT district, kind, count(*) AS n, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.75), 4) AS q75 FROM listing GROUP BY ALL HAVING count(*) >= 5")
def group_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _round(areas.quantile_table(listing(spark, d), ["district", "kind"], "price", least=5))


@query(f"""WITH {LISTING}, s AS (SELECT ward, count(*) AS n, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS q50, quantile_cont(price, 0.75) AS q75 FROM listing GROUP BY ward HAVING count(*) >= 20),
m AS (SELECT ward, district FROM listing GROUP BY ward, district QUALIFY row_number() OVER (PARTITION BY ward ORDER BY count(*) DESC, district) = 1), c AS (SELECT quantile_cont(price, 0.5) AS city FROM listing)
SELECT ward, n, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, district, round(100 * (q50 / city - 1), 4) AS gap, round(100 * (q75 - q25) / q50, 4) AS spread, row_number() OVER (ORDER BY q50 DESC, ward)::INT AS rank FROM s LEFT JOIN m USING (ward), c""")
def ward_table(spark: SparkSession, d: str) -> DataFrame:
    return _round(areas.ward_table(listing(spark, d)))


@query(f"WITH {LISTING}, c AS (SELECT ward, kind, count(*) AS n FROM listing GROUP BY ALL) SELECT ward, arg_min(kind, (-n, kind)) AS kind, count(*) AS n_values, sum(n)::BIGINT AS n FROM c GROUP BY ward")
def ward_modes(spark: SparkSession, d: str) -> DataFrame:
    return areas.mode_table(listing(spark, d), ["ward"], "kind")


GROUPED = "SELECT *, median(lat) OVER (PARTITION BY ward) AS mlat, median(lon) OVER (PARTITION BY ward) AS mlon, count(*) OVER (PARTITION BY ward) AS n FROM places"


@query(f"WITH {PLACES}, g AS ({GROUPED}) SELECT row_id, n >= 5 AND {km_sql('lat', 'lon', 'mlat', 'mlon')} > 10 AS stray FROM g")
def stray_pins(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.with_stray(places(spark, d), "ward", most_km=10.0).select("row_id", "stray")


X, Y = "(lon * (111.32 * cos(radians(21.0))))", "(lat * 111.32)"
GRID = f"""g0 AS (SELECT {X} AS x, {Y} AS y, price FROM places),
""" + ",\n".join(
    f"a{i} AS (SELECT *, count(*) OVER (PARTITION BY floor(x / {s}), floor(y / {s})) AS c FROM g{i}), s{i} AS (SELECT {s}::DOUBLE AS size, x, y, price FROM a{i} WHERE {'c >= 5' if s < 4 else 'TRUE'}), g{i + 1} AS (SELECT x, y, price FROM a{i} WHERE {'c < 5' if s < 4 else 'FALSE'})"
    for i, s in enumerate((0.5, 1.0, 2.0, 4.0))
)


@query(f"""WITH {PLACES}, {GRID}, u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)
SELECT size, floor(x / size)::BIGINT AS cx, floor(y / size)::BIGINT AS cy, count(*) AS n, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.75), 4) AS q75 FROM u GROUP BY ALL""")
def adaptive_grid(spark: SparkSession, d: str) -> DataFrame:
    return _round(areas.adaptive_grid(places(spark, d)))


@query(f"WITH {PLACES} SELECT row_id, count(*) OVER (PARTITION BY round_even(lat, 2), round_even(lon, 2)) AS at_pin FROM places")
def pin_counts(spark: SparkSession, d: str) -> DataFrame:
    return areas.pins(places(spark, d), places=2).select("row_id", "at_pin")


@query(f"""WITH {PLACES}, p AS (SELECT DISTINCT round_even(lat, 3) AS lat, round_even(lon, 3) AS lon FROM places), n AS (SELECT a.lat, a.lon FROM p a JOIN p b ON (a.lat <> b.lat OR a.lon <> b.lon) AND {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 3 GROUP BY ALL HAVING count(*) >= 5)
SELECT row_id FROM places WHERE (round_even(lat, 3), round_even(lon, 3)) IN (SELECT (lat, lon) FROM n)""")
def dense_pins(spark: SparkSession, d: str) -> DataFrame:
    return areas.dense_pins(places(spark, d), km=3.0, places=3).select("row_id")


@query(f"WITH {PLACES} SELECT row_id, price FROM places QUALIFY row_number() OVER (PARTITION BY floor({X} / 5), floor({Y} / 5) ORDER BY price DESC, row_id) = 1")
def thinned(spark: SparkSession, d: str) -> DataFrame:
    return areas.thin(places(spark, d), 5.0, "price").select("row_id", "price")


@query(f"WITH {PLACES} SELECT row_id, round({km_sql('lat', 'lon', '21.0', '105.7')}, 6) AS km FROM places WHERE {km_sql('lat', 'lon', '21.0', '105.7')} <= 10")
def radius_search(spark: SparkSession, d: str) -> DataFrame:
    return _round(areas.within(places(spark, d), 21.0, 105.7, 10.0).select("row_id", "km"), 6)


@query(f"""WITH {PLACES} SELECT a.row_id AS l_row_id, b.row_id AS r_row_id, round({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km, row_number() OVER (PARTITION BY a.row_id ORDER BY {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, b.row_id)::INT AS rank
FROM places a JOIN places b ON a.row_id <> b.row_id AND {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 4 QUALIFY rank <= 5""")
def nearest_listings(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    return _round(areas.nearest(p, p, k=5, km=4.0), 6)


@query(f"""WITH {PLACES} SELECT a.row_id AS l_row_id, b.row_id AS r_row_id, round({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km, row_number() OVER (PARTITION BY a.row_id ORDER BY {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, b.row_id)::INT AS rank
FROM places a JOIN places b ON a.row_id <> b.row_id QUALIFY rank <= 5""")
def nearest_anywhere(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every listing, however far."""
    p = places(spark, d)
    return _round(areas.nearest(p, p, k=5), 6)


KINDS = range(10)


@query(f"""WITH {PLACES}, poi AS (SELECT ward AS kind, lat, lon FROM places WHERE price >= 73e6), r AS (SELECT row_id, lat, lon FROM places),
j AS (SELECT r.row_id, kind, {km_sql('r.lat', 'r.lon', 'poi.lat', 'poi.lon')} AS km FROM r JOIN poi ON {km_sql('r.lat', 'r.lon', 'poi.lat', 'poi.lon')} <= 8)
SELECT r.row_id, {', '.join(f'round(min(km) FILTER (kind = {i}), 6) AS near_{i}, count(*) FILTER (kind = {i}) AS count_{i}' for i in KINDS)},
round(1 + 99 * ({' + '.join(f'coalesce(exp(-(min(km) FILTER (kind = {i})) / {2.0 + i % 2}), 0) * {1 + i % 3}' for i in KINDS)}) / {sum(1 + i % 3 for i in KINDS)}, 6) AS score FROM r LEFT JOIN j USING (row_id) GROUP BY r.row_id""")
def poi_scores(spark: SparkSession, d: str) -> DataFrame:
    """Dear listings as points of interest of their ward's kind."""
    p = places(spark, d)
    poi = p.where("price >= 73e6").select(F.col("ward").cast("string").alias("kind"), "lat", "lon")
    out = areas.poi_features(p, poi, tuple(map(str, KINDS)), 8.0)
    return _round(out.withColumn("score", areas.weighted_score([(areas.closeness(F.col(f"near_{i}"), 2.0 + i % 2), float(1 + i % 3)) for i in KINDS])), 6)


RECTANGLES = [(i, 20.6 + 0.1 * i, 105.35 + 0.08 * i, 20.85 + 0.1 * i, 105.6 + 0.08 * i) for i in range(5)]
RECT_SQL = f"rect AS (SELECT * FROM (VALUES {', '.join(str(r) for r in RECTANGLES)}) v(polygon, s, w, n, e))"


def _rectangles(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = lambda s, w, n, e: F.array(corner(w, s), corner(e, s), corner(e, n), corner(w, n), corner(w, s))
    rows = F.array(*(F.struct(F.lit(i).cast("int").alias("polygon"), F.array(F.array(ring(*box))).alias("parts")) for i, *box in RECTANGLES))
    return table(spark, d, "region").limit(1).select(F.explode(rows).alias("r")).select("r.*")


@query(f"""WITH {PLACES}, {RECT_SQL}, h AS (SELECT polygon, price FROM places JOIN rect ON lat >= s AND lat < n AND lon >= w AND lon < e),
g AS (SELECT polygon::INT AS polygon, count(*) AS n, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS q50, quantile_cont(price, 0.75) AS q75 FROM h GROUP BY polygon),
k AS (SELECT quantile_cont(q50, [{', '.join(f'{i}.0::DOUBLE / 7' for i in range(1, 7))}]) AS edges FROM g WHERE n >= 20)
SELECT polygon, n, round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, CASE WHEN n >= 20 THEN len(list_filter(edges, lambda e: e < q50)) ELSE -1 END::INT AS class FROM g, k""")
def choropleth(spark: SparkSession, d: str) -> DataFrame:
    inside = areas.contains(places(spark, d), _rectangles(spark, d))
    return _round(areas.quantile_classes(areas.quantile_table(inside, ["polygon"], "price"), "q50"))


@query(f"""WITH {PLACES}, c AS (SELECT ward AS centre, median(lat) AS clat, median(lon) AS clon FROM places GROUP BY ward)
SELECT row_id, arg_min(centre, ({km_sql('lat', 'lon', 'clat', 'clon')}, centre)) AS centre, round(min({km_sql('lat', 'lon', 'clat', 'clon')}), 6) AS km FROM places, c GROUP BY row_id""")
def nearest_ward(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    centres = p.groupBy(F.col("ward").alias("centre")).agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))
    return _round(areas.nearest_centre(p, centres), 6)


@query(f"""WITH {PLACES}, k AS (SELECT *, row_id % 5 = 0 AS lost, row_id % 40 AS street FROM places), o AS (SELECT * REPLACE (CASE WHEN NOT lost THEN lat END AS lat, CASE WHEN NOT lost THEN lon END AS lon) FROM k),
s AS (SELECT street, ward, median(lat) AS la, median(lon) AS lo, count(*) AS n FROM o WHERE lat IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), w AS (SELECT ward, median(lat) AS la, median(lon) AS lo, count(*) AS n FROM o WHERE lat IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT row_id, CASE WHEN lat IS NOT NULL THEN 'own' WHEN s.n IS NOT NULL THEN 'street' WHEN w.n IS NOT NULL THEN 'ward' END AS level, coalesce(CASE WHEN lat IS NOT NULL THEN 1 END, s.n, w.n) AS support,
round(coalesce(lat, s.la, w.la), 6) AS lat_found, round(coalesce(lon, s.lo, w.lo), 6) AS lon_found FROM o LEFT JOIN s USING (street, ward) LEFT JOIN w ON o.ward = w.ward""")
def coordinate_cascade(spark: SparkSession, d: str) -> DataFrame:
    lost = F.col("row_id") % 5 == 0
    p = places(spark, d).withColumn("street", F.col("row_id") % 40).withColumn("lat", F.when(~lost, F.col("lat"))).withColumn("lon", F.when(~lost, F.col("lon")))
    out = areas.cascade(p, [("street", ["street", "ward"]), ("ward", ["ward"])])
    return _round(out.select("row_id", "level", F.col("support").cast("long").alias("support"), "lat_found", "lon_found"), 6)


@query(f"""WITH {PLACES}, o AS (SELECT a.row_id, median(b.lat) AS lat, median(b.lon) AS lon FROM places a JOIN places b ON a.ward = b.ward AND a.row_id <> b.row_id GROUP BY a.row_id),
e AS (SELECT p.ward, {km_sql('p.lat', 'p.lon', 'o.lat', 'o.lon')} AS km FROM places p JOIN o USING (row_id))
SELECT ward, count(*) AS n, round(quantile_cont(km, 0.5), 4) AS q50, round(quantile_cont(km, 0.9), 4) AS q90, round(quantile_cont(km, 0.95), 4) AS q95 FROM e GROUP BY ward""")
def left_out_errors(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    out = areas.with_left_out_median(areas.with_left_out_median(p, "lat", ["ward"], "olat"), "lon", ["ward"], "olon")
    out = out.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon"))).where("km IS NOT NULL")
    return _round(areas.quantile_table(out, ["ward"], "km", (0.5, 0.9, 0.95)))


@query(f"""WITH {PLACES}, c AS (SELECT floor({X} / 2)::BIGINT AS cx, floor({Y} / 2)::BIGINT AS cy, sum(ln(price)) AS s, count(*)::DOUBLE AS n FROM places GROUP BY ALL), k AS (SELECT unnest(range(-3, 4)) AS d),
a AS (SELECT cx + d AS cx, cy, sum(s * exp(-pow(d * 2.0 / 3.0, 2) / 2)) AS s, sum(n * exp(-pow(d * 2.0 / 3.0, 2) / 2)) AS n FROM c, k GROUP BY cx + d, cy),
b AS (SELECT cx, cy + d AS cy, sum(s * exp(-pow(d * 2.0 / 3.0, 2) / 2)) AS s, sum(n * exp(-pow(d * 2.0 / 3.0, 2) / 2)) AS n FROM a, k GROUP BY cx, cy + d)
SELECT cx, cy, round(exp(b.s / b.n), 2) AS mean FROM b SEMI JOIN c USING (cx, cy)""")
def price_surface(spark: SparkSession, d: str) -> DataFrame:
    return _round(areas.smooth(places(spark, d), "price", 2.0, 3.0), 2)


@query(f"WITH {LISTING} SELECT district, array_to_string(list_sort(list_distinct(list(ward))), ',') AS wards FROM listing GROUP BY district")
def location_tree(spark: SparkSession, d: str) -> DataFrame:
    return areas.location_tree(listing(spark, d)).select("district", F.array_join("wards", ",").alias("wards"))


# Search


@query(f"WITH {LISTING} SELECT row_id FROM listing WHERE district = 'ASIA' AND price <= 150000 AND area >= 60 AND NOT coalesce(rooms = 1, FALSE)")
def relaxed_search(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    wanted = [
        search.Condition("place", c("district") == "ASIA"), search.Condition("impossible", c("area") > 1e6), search.Condition("price", c("price") <= 150_000),
        search.Condition("area", c("area") >= 60), search.Condition("not one room", c("rooms") != 1, unknown=True),
    ]
    return search.relax(listing(spark, d), wanted)[0].select("row_id")


@query(f"WITH {LISTING} SELECT row_id, row_number() OVER (ORDER BY round(abs(price - 150000) / 150000 + abs(area - 80) / 80, 9), seen DESC, row_id)::INT AS place FROM listing ORDER BY 2 LIMIT 50")
def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    score = F.round(search.match_score(F.col("price"), F.col("area"), 150_000, None, 80, None), 9)
    top = search.ranked(listing(spark, d), score).limit(50)
    return top.select("row_id", F.row_number().over(Window.orderBy(score.asc_nulls_last(), F.col("seen").desc_nulls_last(), "row_id")).alias("place"))


@query(f"WITH {LISTING} SELECT row_id, round(abs(area - 75) / 75, 6) AS area_gap, coalesce(abs(rooms - 2), 9) AS room_gap FROM listing WHERE ward = 'NATION_2' ORDER BY abs(area - 75) / 75, 3, 1 LIMIT 10")
def comparables(spark: SparkSession, d: str) -> DataFrame:
    return _round(search.comparables(listing(spark, d), "NATION_2", "ASIA", 75.0, 2).select("row_id", "area_gap", "room_gap"), 6)


@query(f"""WITH {LISTING} SELECT ward, count(*) AS n, count(*) FILTER (rooms >= 2) AS fitting, count(*) FILTER (rooms >= 2 AND price <= 100000) AS affordable, round(median(price) FILTER (rooms >= 2), 4) AS median_price,
median(area) FILTER (rooms >= 2) AS median_area, round((count(*) FILTER (rooms >= 2 AND price <= 100000))::DOUBLE / count(*) FILTER (rooms >= 2), 6) AS share FROM listing GROUP BY ward HAVING count(*) FILTER (rooms >= 2) > 0""")
def budget(spark: SparkSession, d: str) -> DataFrame:
    out = search.budget(listing(spark, d), 100_000, F.col("rooms") >= 2)
    return out.withColumn("share", F.round("share", 6)).withColumn("median_price", F.round("median_price", 4))


@query(f"WITH {LISTING} SELECT count(*) AS n, min(price) AS lowest, round(quantile_cont(price, 0.25), 4) AS q25, round(median(price), 4) AS median FROM listing WHERE rooms = 3 HAVING count(*) >= 5 AND min(price) > 1000")
def price_hint(spark: SparkSession, d: str) -> DataFrame:
    return _round(search.price_hint(listing(spark, d).where("rooms = 3"), 1_000))


@query(f"WITH {LISTING} SELECT 'rooms' AS \"column\", round(avg((rooms IS NOT NULL)::INT), 6) AS share FROM listing HAVING share < 0.9")
def coverage_notes(spark: SparkSession, d: str) -> DataFrame:
    return _round(search.coverage_notes(listing(spark, d), ["price", "rooms", "ward"], 0.9), 6)


# Valuation

FOLD = "(('0x' || substr(md5(row_id::VARCHAR), 1, 8))::BIGINT % 5)::INT"


@query(f"""WITH {LISTING}, f AS (SELECT *, ln(1 + price) AS y, {FOLD} AS fold FROM listing), c AS (SELECT ward, fold, sum(y) AS s, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT sum(s) AS s, sum(n) AS n FROM c),
o AS (SELECT fold, sum(s) AS s, sum(n) AS n FROM c GROUP BY fold), w AS (SELECT ward, sum(s) AS s, sum(n) AS n FROM c GROUP BY ward)
SELECT row_id, f.fold, round(((w.s - c.s) + (t.s - o.s) / (t.n - o.n) * 10) / ((w.n - c.n) + 10), 6) AS enc_ward FROM f JOIN c ON f.ward = c.ward AND f.fold = c.fold JOIN o ON f.fold = o.fold JOIN w ON f.ward = w.ward, t""")
def target_encoding(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("fold", valuation.fold_of(F.col("row_id")))
    return _round(valuation.encode(rows, "ward", F.log1p("price"), fold="fold").select("row_id", "fold", "enc_ward"), 6)


@query(f"""WITH {LISTING}, s AS (SELECT district, abs(price - median(price) OVER (PARTITION BY ward)) AS score FROM listing), r AS (SELECT district, score, count(*) OVER (PARTITION BY district) AS n, row_number() OVER (PARTITION BY district ORDER BY score) - 1 AS r FROM s)
SELECT district, n, round(score, 4) AS "offset" FROM r WHERE r = ceil(least(ceil((n + 1) * (1 - 0.1::DOUBLE)) / n, 1) * (n - 1))""")
def conformal_offsets(spark: SparkSession, d: str) -> DataFrame:
    scored = listing(spark, d).withColumn("score", F.abs(F.col("price") - F.median("price").over(Window.partitionBy("ward"))))
    return _round(valuation.conformal_offset(scored, "score", 0.1, ["district"]))


MEDIAN = "p AS (SELECT *, median(price) OVER (PARTITION BY ward) AS predicted FROM listing)"


@query(f"""WITH {LISTING}, {MEDIAN} SELECT district, count(*) AS n, round(100 * avg(abs(predicted - price) / price), 6) AS mape, round(100 * median(abs(predicted - price) / price), 6) AS median_error, round(avg(abs(predicted - price)), 4) AS mae,
round(1 - sum((predicted - price) ** 2) / (var_pop(price) * count(*)), 6) AS r2, round(avg((abs(predicted - price) / price <= 0.1)::INT), 6) AS within_10, round(avg((abs(predicted - price) / price <= 0.2)::INT), 6) AS within_20 FROM p GROUP BY district""")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("predicted", F.median("price").over(Window.partitionBy("ward")))
    return _round(valuation.accuracy(rows, ["district"]), 6).withColumn("mae", F.round("mae", 4))


@query(f"""WITH {LISTING}, {MEDIAN} SELECT ward, count(*) AS n, round(avg((price BETWEEN predicted * 0.5 AND predicted * 1.5)::INT), 6) AS covered, round(avg(predicted / 2 / price), 6) AS mean_width, round(median(predicted / 2 / price), 6) AS median_width FROM p GROUP BY ward HAVING count(*) >= 20""")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("predicted", F.median("price").over(Window.partitionBy("ward")))
    return _round(valuation.coverage(rows.withColumn("low", F.col("predicted") * 0.5).withColumn("high", F.col("predicted") * 1.5), ["ward"]), 6)


@query(f"WITH {LISTING}, g AS (SELECT stddev_samp(price) / avg(price) AS cv FROM listing GROUP BY ward, kind, rooms, floor(area / 5) HAVING count(price) >= 2) SELECT count(*) AS twins, round(100 * avg(cv), 4) AS noise FROM g")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return _round(valuation.noise_floor(listing(spark, d), ["ward", "kind", "rooms", F.floor(F.col("area") / 5)], "price"))


@query(f"WITH {LISTING} SELECT district, count(*) AS n, round(regr_slope(ln(price), ln(area)), 6) AS slope, round(regr_intercept(ln(price), ln(area)), 6) AS intercept, round(sqrt((regr_syy(ln(price), ln(area)) - regr_slope(ln(price), ln(area)) ** 2 * regr_sxx(ln(price), ln(area))) / (count(*) - 2) / regr_sxx(ln(price), ln(area))), 6) AS error FROM listing GROUP BY district")
def price_slope(spark: SparkSession, d: str) -> DataFrame:
    return _round(valuation.slope(listing(spark, d), F.log("area"), F.log("price"), ["district"]), 6)


@query()
def boosted_valuation(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated prices and conformal intervals of parts, by boosted trees."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), (F.col("p_partkey") % 1000).cast("double").alias("code"))
    return valuation.cross_validated(rows, ["size", "code"], ["brand", "type"])


@query()
def forest_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 1000).cast("double").alias("code"))
    hold = valuation.fold_of(F.col("row_id")) == 0
    return valuation.quantile_forest(rows.where(~hold), rows.where(hold), ["size", "code"], "price")


# Text and pages

@query("""SELECT o_orderkey, round(o_totalprice / 1000) / 100 * 1e9 AS price, round(o_totalprice / 100) / 10 * 1e6 AS ppm2, (o_orderkey % 900 + 100)::DOUBLE * 1000 AS grouped,
CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE ((o_orderkey % 9 + 1)::VARCHAR || '.' || (o_orderkey % 10)::VARCHAR)::DOUBLE * 1e9 END AS hint, CASE WHEN o_orderkey % 80 BETWEEN 1 AND 60 THEN (o_orderkey % 80)::DOUBLE END AS floor,
CASE WHEN 4 * (1 + o_orderkey % 15) <= 50 THEN 4 * (1 + o_orderkey % 15)::DOUBLE END AS frontage FROM orders""")
def written_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Prices, areas and sizes written the way ads write them, then read back."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    price = F.concat(comma((F.round(F.col("o_totalprice") / 1000) / 100).cast("decimal(18,2)")), F.lit(" tỷ"))
    ppm2 = F.concat(comma((F.round(F.col("o_totalprice") / 100) / 10).cast("decimal(18,1)")), F.lit(" triệu/m²"))
    grouped = F.concat((key % 900 + 100).cast("string"), F.lit(".000 đ"))
    hint = F.when(key % 10 != 0, F.concat(F.lit("Bán gấp "), (key % 9 + 1).cast("string"), F.lit("t"), (key % 10).cast("string"), F.lit(" chính chủ"))).otherwise("thương lượng")
    front = F.concat(F.lit("Mặt tiền: "), (4 * (1 + key % 15)).cast("string"), F.lit(" m"))
    return o.select(
        "o_orderkey", text.price(price).alias("price"), text.price_per_area(ppm2).alias("ppm2"), text.first_number(grouped).alias("grouped"), text.price_hint(hint).alias("hint"),
        text.floor(F.concat(F.lit("căn hộ Tầng "), (key % 80).cast("string"), F.lit(" view đẹp"))).alias("floor"), text.frontage(front).alias("frontage"),
    )


@query("SELECT doc_id, md5(strip_accents(lower(coalesce(text, '')))) AS folded FROM documents")
def folded_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold("text")).alias("folded"))


@query("SELECT p_partkey, p_brand AS brand, p_type AS type, p_size AS size FROM part")
def attribute_blob(spark: SparkSession, d: str) -> DataFrame:
    """Labels and values run together, then parted by the known labels."""
    blob = F.concat(F.lit("Thương hiệu"), "p_brand", F.lit("Loại hình"), "p_type", F.lit("Diện tích"), F.col("p_size").cast("string"), F.lit(" m²"))
    found = table(spark, d, "part").select("p_partkey", text.attributes(blob, ["Thương hiệu", "Loại hình", "Diện tích"]).alias("m"))
    return found.select("p_partkey", F.col("m")["Thương hiệu"].alias("brand"), F.col("m")["Loại hình"].alias("type"), text.area(F.col("m")["Diện tích"]).cast("int").alias("size"))


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::INT AS n_links, TRY_CAST(regexp_extract(html, 'track\((\d+)\)', 1) AS BIGINT) AS track,
regexp_extract(url, '^https?://(?:www\.|m\.)?([^/]+)', 1) AS host FROM pages""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(html.links(h)).alias("n_links"), F.regexp_extract(h, r"track\((\d+)\)", 1).try_cast("long").alias("track"), F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/]+)", 1).alias("host"))


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.first_tag(F.col("html"), "title").alias("title"), html.plain_text(F.col("html")).alias("text"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k, event_type FROM events")
def event_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", *files.project_json(F.col("props"), {"k": "int"}), "event_type")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS count FROM events GROUP BY ALL")
def daily_events(spark: SparkSession, d: str) -> DataFrame:
    out = sightings.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


import hearthline.plans.appraisal_queries  # noqa: E402, F401
import hearthline.plans.intake_queries  # noqa: E402, F401
import hearthline.plans.market_queries  # noqa: E402, F401
import hearthline.plans.model_queries  # noqa: E402, F401
import hearthline.plans.place_queries  # noqa: E402, F401
import hearthline.plans.surface_queries  # noqa: E402, F401

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return ward_table(spark, d)

