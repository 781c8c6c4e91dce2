"""Queries of stored ads and their columns, project names, batches, new wards, choices, orders of results and what-if prices, beside the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.functions import projects
from hearthline.operators import bundles, places as op, search
from hearthline.plans.market_queries import _spelled, _sql_fold
from hearthline.plans.registry import query, rounded
from hearthline.plans.views import LISTING, PLACES, km_sql, listing, places, table
from hearthline.sources import files, reconcile

# Stored ads

USER = "CAST(user_id AS STRING)"
MIXED = _spelled("event_id", [
    "props", """concat('{"k": "', event_type, '", "v": ', CAST(value AS STRING), '}')""", """'{"v": 7, "on": true, "tags": [1, 2], "small": 5}'""", "'broken'", None,
    f"""concat('{{"v": ', {USER}, ', "day": "2024-01-31", "on": null}}')""", f"""concat('{{"id": ', CAST(event_id + 9007199254740993 AS STRING), ', "code": "00', {USER}, '"}}')""",
    f"""concat('{{"id": ', {USER}, ', "wide": 12345678901234567890.5}}')""", """'{"wide": 1, "day": "2024-02-29"}'""", "'[1]'", "'{}'",
])
KIND = """CASE json_type(x) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'nested' WHEN 'OBJECT' THEN 'nested' WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(t, '\\d{4}-\\d\\d-\\d\\d') THEN 'date' ELSE 'text' END
  ELSE CASE WHEN regexp_full_match(t, '\\d{1,15}') THEN 'whole' WHEN regexp_full_match(t, '\\d{16,18}') THEN 'long' WHEN length(t) <= 16 THEN 'fraction' ELSE 'exact' END END"""
CELLS = f"""p AS (SELECT event_id, {MIXED.replace('STRING', 'VARCHAR')} AS payload FROM events), o AS (SELECT event_id, payload, json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT' AS good FROM p),
u AS (SELECT payload::JSON AS j, unnest(json_keys(payload::JSON)) AS "column" FROM o WHERE good), x AS (SELECT "column", json_extract(j, concat('$.', "column")) AS x, json_extract_string(j, concat('$.', "column")) AS t FROM u), k AS (SELECT "column", {KIND} AS kind FROM x WHERE t IS NOT NULL)"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.expr(MIXED).alias("payload"))


@query(f"""WITH {CELLS}, g AS (SELECT "column", kind, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT "column", sum(n)::BIGINT AS n, string_agg(concat(kind, ':', n), ',' ORDER BY concat(kind, ':', n)) AS kinds, list(kind) AS l, coalesce(sum(n) FILTER (kind = 'whole'), 0)::BIGINT AS whole, coalesce(sum(n) FILTER (kind IN ('text', 'date')), 0)::BIGINT AS words FROM g GROUP BY 1),
t AS (SELECT *, CASE WHEN list_has_all(['whole', 'long'], l) THEN 'bigint' WHEN list_has_all(['whole', 'fraction'], l) THEN 'double' WHEN l = ['boolean'] THEN 'boolean' WHEN l = ['date'] THEN 'date' ELSE 'string' END AS type FROM s)
SELECT "column", n, kinds, type, CASE type WHEN 'double' THEN whole WHEN 'string' THEN n - words ELSE 0 END AS moved FROM t""")
def mixed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events, some respelt with fields of several types: the kinds of values of each field over all rows, and the type that holds them all."""
    return reconcile.column_report(reconcile.json_kinds(_payloads(spark, d), "payload"))


@query(f"""WITH {CELLS} SELECT event_id, CASE WHEN good THEN payload ->> '$.k' END AS k, CASE WHEN good THEN (payload ->> '$.v')::DOUBLE END AS v, CASE WHEN good THEN (payload ->> '$.on')::BOOLEAN END AS "on", CASE WHEN good THEN payload ->> '$.tags' END AS tags, CASE WHEN good THEN (payload ->> '$.small')::BIGINT END AS small,
CASE WHEN good THEN payload ->> '$.day' END AS day, CASE WHEN good THEN (payload ->> '$.id')::BIGINT END AS id, CASE WHEN good THEN payload ->> '$.code' END AS code, CASE WHEN good THEN nullif(regexp_extract(payload, '"wide": ([0-9.]+)', 1), '') END AS wide, CASE WHEN NOT good THEN payload END AS unread FROM o""")
def reconciled_events(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as a table: each field in the type found for it."""
    rows = _payloads(spark, d)
    types = reconcile.column_types(reconcile.column_report(reconcile.json_kinds(rows, "payload")))
    return reconcile.typed_json(rows, "payload", types).withColumn("day", F.col("day").cast("string"))


AD = """concat('{"list_time": ', CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1704067200000 + event_id * 1001 END AS STRING), ', "price": ', CAST(value AS STRING), ', "ward_name": "Ward ', CAST(user_id AS STRING), '"', CASE WHEN event_id % 11 = 0 THEN '' ELSE '}' END)"""


@query(f"""WITH a AS (SELECT event_id, event_type, user_id, {AD.replace('STRING', 'VARCHAR')} AS p FROM events), j AS (SELECT *, CASE WHEN json_valid(p) THEN p::JSON END AS j FROM a)
SELECT event_id AS list_id, (j ->> '$.price')::DOUBLE AS price, j ->> '$.ward_name' AS ward_name, event_type AS kind, make_timestamp((1704067200 + event_id) * 1000000) AS first_seen, make_timestamp((1704067200 + event_id + user_id) * 1000000) AS last_seen, user_id AS times,
make_timestamp(nullif((j ->> '$.list_time')::BIGINT, 0) * 1000) AS posted, concat('https://ads.example/', event_id, '.htm') AS url FROM j WHERE event_type = 'purchase'""")
def exported_ads(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as stored ads of one kind, some with a broken JSON or no time, as a flat table."""
    start = F.lit(1704067200).cast("long") + F.col("event_id")
    ads = table(spark, d, "events").select(F.col("event_id").alias("list_id"), F.expr(AD).alias("payload"), F.col("event_type").alias("kind"), start.alias("first_seen"), (start + F.col("user_id")).alias("last_seen"), F.col("user_id").alias("times"))
    out = files.export_table(ads, {"price": "double", "ward_name": "string"}, "https://ads.example/{}.htm", kind="purchase")
    whole = F.col("ward_name").isNotNull()  # a broken JSON may give the fields before the break
    return out.withColumn("price", F.when(whole, F.col("price"))).withColumn("posted", F.when(whole, F.col("posted")))


# Names

TITLES = _spelled("o_orderkey", [
    "concat('Bán căn hộ CT', CAST(o_orderkey % 9 AS STRING), 'A Đại Thanh giá tốt')", "'Chung cư HH2B  Linh Đàm'", "'HH - tòa 3 linh đàm'", "'KĐT Linh Đàm, 2PN'", "'The Park Hill Times City'", "'Lumière riverside'", "'FLC  nhà đẹp 36 Phạm Hùng garden'", "'FLC Twin'",
    None, "'-'", "concat('Nhà riêng ', o_orderpriority)", "'vinhomes SMARTCITY tây mỗ'", "'Rise City Sông Hồng'", "'rice city tây nam'", "'TP Giao Lưu'", "'căn hộ Imperia garden'", "'IMPERIA SKY GARDEN'", "'ruby-city ct3'", "'Rubycon'",
])


def _project_sql(t: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({t}, '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{name}'" for name, ps in projects.PROJECT_ALIASES.items())
    return f"CASE {cases} ELSE '{projects.UNKNOWN_PROJECT}' END"


@query(f"WITH t AS (SELECT o_orderkey, {_sql_fold(TITLES.replace('STRING', 'VARCHAR'))} AS t FROM orders) SELECT o_orderkey, {_project_sql('t')} AS project FROM t")
def project_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", projects.known_project(F.expr(TITLES)).alias("project"))


# Places

OLD = {
    "ward": "CASE row_id % 4 WHEN 0 THEN concat('Phường ', ward) WHEN 1 THEN concat('Xã ', ward) WHEN 2 THEN concat('PHƯỜNG  ', ward) END", "district": "CASE district WHEN 0 THEN 'Quận Một' WHEN 1 THEN 'Huyện Hai' END",
    "new_ward": "CASE row_id % 6 WHEN 0 THEN concat('N', ward) WHEN 1 THEN 'Phường cũ' END", "lat": "CASE WHEN row_id % 7 > 0 THEN lat END", "lon": "CASE WHEN row_id % 7 > 0 THEN lon END",
}


def _list(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


@query(f"""WITH {PLACES}, r AS (SELECT row_id, {', '.join(_list(OLD))} FROM places), t AS (SELECT n_nationkey AS w, CASE n_regionkey % 2 WHEN 0 THEN 'mot' ELSE 'hai' END AS d, concat('N', n_nationkey % 8) AS new FROM nation), c AS (SELECT concat('N', ward) AS centre, round(avg(lat), 6) AS la, round(avg(lon), 6) AS lo FROM places GROUP BY 1),
s AS (SELECT row_id, lat, lon, CASE WHEN new_ward IN (SELECT new FROM t) THEN new_ward END AS given, CASE WHEN NOT (coalesce(starts_with(ward, 'Xã'), false) AND coalesce(starts_with(district, 'Quận'), false)) THEN regexp_extract(ward, '\\d+$')::INT END AS w, CASE district WHEN 'Quận Một' THEN 'mot' WHEN 'Huyện Hai' THEN 'hai' END AS d FROM r),
k AS (SELECT s.*, t.new FROM s LEFT JOIN t ON t.w = s.w AND t.d = s.d), n AS (SELECT row_id, arg_min(centre, (km, centre)) AS near, min(km) AS km FROM (SELECT row_id, centre, {km_sql('lat', 'lon', 'la', 'lo')} AS km FROM k, c WHERE given IS NULL AND new IS NULL AND lat IS NOT NULL) GROUP BY row_id)
SELECT row_id, coalesce(given, new, near) AS new_ward, CASE WHEN given IS NOT NULL THEN 'given' WHEN new IS NOT NULL THEN 'table' WHEN near IS NOT NULL THEN 'nearest' ELSE 'unknown' END AS new_ward_from, round(km, 2) AS new_ward_km FROM k LEFT JOIN n USING (row_id)""")
def new_wards(spark: SparkSession, d: str) -> DataFrame:
    """Places with old names, some with a new ward of their own, a false one or none: given, looked up, nearest or unknown."""
    rows = places(spark, d).selectExpr("row_id", *_list(OLD))
    nation = table(spark, d, "nation")
    known = nation.select(F.when(F.col("n_regionkey") % 2 == 0, "Quận Một").otherwise("Huyện Hai").alias("district"), F.concat(F.lit("Phường "), F.col("n_nationkey").cast("string")).alias("ward"), F.concat(F.lit("N"), (F.col("n_nationkey") % 8).cast("string")).alias("new_ward"))
    centres = places(spark, d).groupBy(F.concat(F.lit("N"), F.col("ward").cast("string")).alias("centre")).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
    return op.with_new_ward(rows, known, centres).select("row_id", "new_ward", "new_ward_from", "new_ward_km")


NAMED = {
    "ward": "concat('W', ward)", "district": "concat('D', district)", "street": "CASE WHEN row_id % 5 > 0 THEN concat('S', row_id % 60) END", "project": "CASE row_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN concat('P', row_id % 9) END",
    "lat": "CASE WHEN row_id % 6 > 0 THEN lat END", "lon": "lon", "sure": "row_id % 3 = 0",
}


@query(f"""WITH {PLACES}, r AS (SELECT row_id, {', '.join(_list(NAMED))} FROM places), v AS (SELECT ward, district, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT ward, arg_min(district, (-n, district)) AS district FROM v GROUP BY ward),
p AS (SELECT ward, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM r WHERE project <> 'unknown' GROUP BY ward), k AS (SELECT ward, street FROM r WHERE lat IS NOT NULL AND street IS NOT NULL AND sure GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT ward, string_agg(street, ',' ORDER BY street) AS streets FROM k GROUP BY ward)
SELECT ward, district, coalesce(projects, '') AS projects, coalesce(streets, '') AS streets FROM m LEFT JOIN p USING (ward) LEFT JOIN s USING (ward)""")
def location_choices(spark: SparkSession, d: str) -> DataFrame:
    """Wards under their main district, with their projects and the streets whose place is known from two sure rows or more."""
    rows = places(spark, d).selectExpr("row_id", *_list(NAMED))
    out = op.choices(rows, F.col("sure"), least=2)
    return out.select("ward", "district", F.array_join("projects", ",").alias("projects"), F.array_join("streets", ",").alias("streets"))


@query(f"""WITH {PLACES}, r AS (SELECT row_id, {', '.join(_list(NAMED))} FROM places) SELECT project, count(*) AS n FROM r WHERE lat IS NOT NULL AND project IS NOT NULL GROUP BY project HAVING count(*) >= 3""")
def located_projects(spark: SparkSession, d: str) -> DataFrame:
    return op.known_names(places(spark, d).selectExpr("row_id", *_list(NAMED)), "project")


AREA, PPM2 = "(20 + row_id % 90)", "price / (20 + row_id % 90)"


@query(f"""WITH {PLACES}, r AS (SELECT row_id, price, {AREA}::DOUBLE AS area, {PPM2} AS ppm2, {km_sql('lat', 'lon', '21.0', '105.7')} AS km FROM places WHERE price <= 9e7 AND {AREA} >= 30 AND row_id % 3 < 2)
""" + " UNION ALL ".join(f"(SELECT '{by}' AS ordered, row_id, row_number() OVER (ORDER BY {c}, row_id)::INT AS place FROM r WHERE km <= 20 QUALIFY place <= 50)" for by, c in op.AROUND.items()))
def around_a_point(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 listings within 20 km of a point in each of three orders, under a price, above an area and with a sure place."""
    rows = places(spark, d).selectExpr("*", f"CAST({AREA} AS DOUBLE) AS area", f"{PPM2} AS ppm2", "CASE row_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'street' ELSE 'ward' END AS level")
    out = None
    for by, c in op.AROUND.items():
        top = op.around(rows, 21.0, 105.7, 20.0, by, most_price=9e7, least_area=30, levels=["own", "street"]).limit(50)
        top = top.select(F.lit(by).alias("ordered"), "row_id", F.row_number().over(Window.orderBy(c, "row_id")).alias("place"))  # of 50 rows
        out = top if out is None else out.union(top)
    return out


DEVIATION = "CASE WHEN row_id % 9 > 0 THEN (row_id * 37) % 101 - 50 END"
ORDERS = {search.BEST: "round(abs(price - 150000) / 150000 + abs(area - 80) / 80, 9)", search.CHEAPEST: "price", search.BELOW: "deviation", search.ABOVE: "-deviation"}


@query(f"""WITH {LISTING}, r AS (SELECT *, {DEVIATION} AS deviation FROM listing)
""" + " UNION ALL ".join(f"(SELECT '{how}' AS ordered, row_id, row_number() OVER (ORDER BY {c} NULLS LAST, seen DESC, row_id)::INT AS place FROM r QUALIFY place <= 30)" for how, c in ORDERS.items() if how != search.BEST))
def result_orders(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 listings by price, and the furthest below and above an estimate."""
    rows, out = listing(spark, d).withColumn("deviation", F.expr(DEVIATION)), None
    for how, c in ORDERS.items():
        if how != search.BEST:
            top = search.arranged(rows, how, {"price_to": 150_000, "area_from": 80}).limit(30)
            top = top.select(F.lit(how).alias("ordered"), "row_id", F.row_number().over(Window.orderBy(F.expr(c).asc_nulls_last(), F.desc("seen"), "row_id")).alias("place"))  # of 30 rows
            out = top if out is None else out.union(top)
    return out


BATCH = {
    "listing_id": "CASE WHEN row_id % 5 > 0 THEN CAST(row_id AS INT) % 700 END", "district": "CASE district WHEN 0 THEN 'Quận Một' WHEN 1 THEN 'QUẬN  một' ELSE 'Huyện Hai' END", "ward": "CASE WHEN row_id % 8 > 0 THEN concat('Phường ', ward % 3) END",
    "street": "concat('Ngõ ', row_id % 50, ' Phố Vọng ', ward)", "project": "CASE WHEN row_id % 3 = 0 THEN concat('Chung cư A', ward) END", "new_ward": "concat('Xã N', ward)", "lat": "CASE WHEN row_id % 13 > 0 THEN lat END", "lon": "lon",
}
NARROW = (20.6, 21.3, 105.35, 105.95)


@query(f"""WITH {PLACES}, b AS (SELECT row_id, (row_id % 2)::INT AS batch, {', '.join(_list(BATCH))} FROM places), f AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY batch, row_id) AS r FROM b), o AS (SELECT * FROM f WHERE r = 1 OR listing_id IS NULL),
k AS (SELECT row_id, lat, lon, CASE district WHEN 'Huyện Hai' THEN 'hai' ELSE 'mot' END AS district_key, right(ward, 1) AS ward_key, concat('vong ', regexp_extract(street, '\\d+$')) AS street_key, CASE WHEN batch = 0 AND project IS NOT NULL THEN concat('a', regexp_extract(project, '\\d+')) END AS project_key, concat('n', regexp_extract(new_ward, '\\d+')) AS new_ward_key
  FROM o WHERE lat BETWEEN {NARROW[0]} AND {NARROW[1]} AND lon BETWEEN {NARROW[2]} AND {NARROW[3]}), m AS (SELECT *, median(lat) OVER w AS ma, median(lon) OVER w AS mo, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY district_key, ward_key))
SELECT row_id, district_key, ward_key, street_key, project_key, new_ward_key FROM m WHERE ward_key IS NULL OR n < 5 OR {km_sql('lat', 'lon', 'ma', 'mo')} <= 20""")
def loaded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Places in two batches of one site, with repeated, missing and stray ones; the second batch knows no projects."""
    rows = places(spark, d).selectExpr("row_id", *_list(BATCH))
    out = op.load_batches([rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1").drop("project")], NARROW, most_km=20.0)
    return out.select("row_id", "district_key", "ward_key", "street_key", "project_key", "new_ward_key")


CHANGES = {"rooms": [1, 2, 3], "kind": ["1-URGENT", "5-LOW"]}
PRICE = "area * (rooms + 2) * CASE WHEN kind = '1-URGENT' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END"


@query(f"""WITH {LISTING}, l AS (SELECT row_id, ward, district, area, rooms, kind FROM listing), q AS (SELECT * FROM l WHERE row_id % 50 = 0), c AS (SELECT 'rooms' AS feature, unnest(['1', '2', '3']) AS value UNION ALL SELECT 'kind', unnest(['1-URGENT', '5-LOW'])),
w AS (SELECT q.*, feature, value, CASE feature WHEN 'rooms' THEN rooms::VARCHAR ELSE kind END AS now FROM q, c), p AS (SELECT row_id, ward, district, feature, value, now, {PRICE} AS old, CASE WHEN feature = 'rooms' THEN {PRICE.replace('rooms', 'value::INT')} ELSE {PRICE.replace('kind', 'value')} END AS new FROM w WHERE now IS DISTINCT FROM value),
nw AS (SELECT ward, count(*) AS n FROM l GROUP BY 1), h AS (SELECT ward, district, 'rooms' AS feature, rooms::VARCHAR AS value FROM l UNION ALL SELECT ward, district, 'kind', kind FROM l), hw AS (SELECT ward, feature, value, count(*) AS n FROM h GROUP BY ALL), hd AS (SELECT district, feature, value, count(*) AS n FROM h GROUP BY ALL),
s AS (SELECT p.*, coalesce(CASE WHEN nw.n >= 60 THEN hw.n ELSE hd.n END, 0) AS n FROM p JOIN nw USING (ward) LEFT JOIN hw USING (ward, feature, value) LEFT JOIN hd ON hd.district = p.district AND hd.feature = p.feature AND hd.value = p.value)
SELECT row_id, feature, now, value, round(new, 4) AS predicted, round(100 * (new / old - 1), 1) AS change, n, CASE WHEN n >= 30 THEN 'enough' WHEN n >= 10 THEN 'some' ELSE 'few' END AS trust FROM s""")
def what_if_prices(spark: SparkSession, d: str) -> DataFrame:
    """Every listing whose id is divisible by 50 with other rooms or another kind, priced by a formula, and how many of all listings stand behind each value."""
    known = listing(spark, d).select("row_id", "ward", "district", "area", "rooms", "kind")
    price = lambda rows: rows.withColumn("predicted", F.col("area") * (F.col("rooms") + 2) * F.when(F.col("kind") == "1-URGENT", 1.25).otherwise(1.0))
    out = bundles.what_if(known.where("row_id % 50 = 0"), CHANGES, price, known, least=60)
    return rounded(out.select("row_id", "feature", "now", "value", "predicted", "change", "n", "trust"))
