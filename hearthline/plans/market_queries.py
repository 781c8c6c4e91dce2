"""Registered queries of keys, readers, reports, merges, places and deals, beside the same rows in DuckDB SQL. Texts come in several spellings, with broken and missing ones among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthline.functions import geo, text
from hearthline.operators import areas, market, valuation
from hearthline.plans.registry import query, rounded
from hearthline.plans.views import LISTING, PLACES, listing, places, spread, table
from hearthline.sources import html

Y, X = "(lat * 111.32)", "(lon * (111.32 * cos(radians(21.0))))"


def _sql_fold(x: str) -> str:
    return f"replace(strip_accents(lower(coalesce({x}, ''))), 'đ', 'd')"


def _spelled(key: str, forms: list[str | None]) -> str:
    """The same in both languages: one of the forms by the key's remainder; null for None."""
    cases = " ".join(f"WHEN {i} THEN {f if f else 'NULL'}" for i, f in enumerate(forms))
    return f"CASE CAST({key} % {len(forms)} AS INT) {cases} END"


NAMES = _spelled("conv_id + turn", [
    "concat('Ngõ 58 ', substr(text, 1, 30))", "concat('Số nhà 12 Phố ', substr(text, 5, 20))", "concat('Phường ', substr(text, 1, 12))", "concat('  QUẬN   ', substr(text, 3, 15))",
    "concat('Chung cư ', substr(text, 1, 25), ' Block 7')", None, "'Toà nhà CC'", "text", "'--- !'", "'Ngõ 12 ngách 3 Đường Kim Mã'", "'khu đô thị mới Đại Thanh'",
])
STREET = "street0"
for _ in range(4):
    STREET = rf"regexp_replace(regexp_replace({STREET}, '^(?:{'|'.join(text.STREET_PREFIXES)})\s+', ''), '^\d+\s*', '')"


@query(rf"""WITH n AS (SELECT conv_id, turn, nullif(trim(regexp_replace({_sql_fold(NAMES)}, '[^a-z0-9]+', ' ', 'g')), '') AS street0 FROM conversations)
SELECT conv_id, turn, street0 AS name, nullif({STREET}, '') AS street, nullif(regexp_replace(street0, '^(?:{'|'.join(text.WARD_PREFIXES)})\s+', ''), '') AS ward, nullif(regexp_replace(street0, '^(?:{'|'.join(text.DISTRICT_PREFIXES)})\s+', ''), '') AS district,
nullif(trim(regexp_replace(regexp_replace(street0, '\b(?:{'|'.join(text.PROJECT_WORDS)})\b', ' ', 'g'), '\s+', ' ', 'g')), '') AS project FROM n""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("name", F.expr(NAMES))
    keys = {"name": text.name_key, "street": text.street_key, "ward": text.ward_key, "district": text.district_key, "project": text.project_key}
    return rows.select("conv_id", "turn", *(f(F.col("name")).alias(k) for k, f in keys.items()))


# Letters beyond ASCII are letters to \b here, but not in DuckDB: there they become a q.
@query(f"SELECT doc_id, {', '.join(f'''regexp_matches(f, '{p}')::INT AS mentions_{n}''' for n, p in text.MENTIONS.items())} FROM (SELECT doc_id, regexp_replace({_sql_fold('text')}, '[\\x{{00C0}}-\\x{{1FFF}}]', 'q', 'g') AS f FROM documents)")
def mention_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in text.mentions(F.col("text")).items()))


FEATURES = {"market": "market", "light": "lumière", "road": "Straße", "city": "ciudad"}


@query(f"SELECT doc_id, {', '.join(f'''contains({_sql_fold('text')}, {_sql_fold(f"'{w}'")})::INT AS has_{n}''' for n, w in FEATURES.items())} FROM documents")
def feature_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in text.feature_flags(F.col("text"), FEATURES).items()))


NUM, TENTH = "CAST(o_orderkey % 40 AS STRING)", "CAST(o_orderkey % 10 AS STRING)"
SIZES = _spelled("o_orderkey", [
    f"concat('Ngõ trước nhà rộng ', {NUM}, 'm, đất ', {NUM}, ' x ', {TENTH}, '5m')", f"concat('đường rộng: ', {NUM}, ',', {TENTH}, ' m')", f"concat('DT ', {NUM}, 'm×', {NUM}, '.', {TENTH}, ' m')", None, "''",
    f"concat('hẻm ', {NUM}, ' mét')", "'ngách rộng m'", f"concat('đường ', {NUM}, '99m')",
])


def _sql_first_fit(fold: str, kind: tuple) -> str:
    patterns, low, high = kind
    values = [f"TRY_CAST(replace(nullif(regexp_extract({fold}, '{p}', 1), ''), ',', '.') AS DOUBLE)" for p in patterns]
    return f"coalesce({', '.join(f'CASE WHEN {v} BETWEEN {low} AND {high} THEN {v} END' for v in values)})"


@query(f"WITH s AS (SELECT o_orderkey, {_sql_fold(SIZES.replace('STRING', 'VARCHAR'))} AS f FROM orders) SELECT o_orderkey, {_sql_first_fit('f', text.ROAD_WIDTH)} AS road_width, {_sql_first_fit('f', text.DEPTH)} AS depth FROM s")
def sizes_in_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("s", F.expr(SIZES))
    return rows.select("o_orderkey", text.road_width(F.col("s")).alias("road_width"), text.depth(F.col("s")).alias("depth"))


PRICES = _spelled("o_orderkey", [f"concat({NUM}, ',', {TENTH}, ' tỷ')", f"concat('1.', {TENTH}, '00,5 triệu')", f"concat('giá ', {NUM}, '.', {TENTH}, ' Tỷ')", "'thoả thuận'", None, f"concat({NUM}, ' m²')", "'.,'"])


@query(f"""WITH s AS (SELECT o_orderkey, {_sql_fold(PRICES.replace('STRING', 'VARCHAR'))} AS f FROM orders), t AS (SELECT o_orderkey, f, nullif(regexp_extract(f, '([\\d.,]+)', 1), '') AS n FROM s),
u AS (SELECT o_orderkey, f, CASE WHEN contains(n, '.') AND contains(n, ',') THEN replace(n, '.', '') ELSE n END AS n FROM t)
SELECT o_orderkey, round(TRY_CAST(replace(n, ',', '.') AS DOUBLE) * CASE WHEN contains(f, 'ty') THEN 1e9 WHEN contains(f, 'trieu') THEN 1e6 ELSE 1.0 END, 2) AS value FROM u""")
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.round(text.html_number(F.expr(PRICES)), 2).alias("value"))


ADDRESSES = _spelled("c_custkey", [
    "concat('Số ', c_custkey, ' Phố Vọng,  Phường Phương Mai, Quận Đống Đa, Hà Nội')", "'Xã Tân Triều, Huyện Thanh Trì'", "'Đường Láng, Quận Cầu Giấy, Hà Nội'", None, "''", "'Thị trấn Văn Điển'", "c_name", "'Ngõ 5 , phường Láng Hạ'",
])


@query(rf"""WITH a AS (SELECT c_custkey, trim(regexp_replace({ADDRESSES}, '\s+', ' ', 'g')) AS t FROM customer)
SELECT c_custkey, nullif(trim(regexp_replace(regexp_replace(t, '(?i)(?:^|,)\s*(?:phường|xã|thị trấn)\s.*$', ''), '(?i)(?:^|,)\s*(?:quận|huyện|thị xã)\s.*$', '')), '') AS street,
nullif(regexp_extract(t, '(?i)(?:^|,)\s*((?:phường|xã|thị trấn)\s+[^,]+)', 1), '') AS ward, nullif(regexp_extract(t, '(?i)(?:^|,)\s*((?:quận|huyện|thị xã)\s+[^,]+)', 1), '') AS district FROM a""")
def address_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", *(c.alias(n) for n, c in text.address_parts(F.expr(ADDRESSES)).items()))


@query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Xã Tả' WHEN 1 THEN 'Phường Tả' WHEN 2 THEN 'XÃ Hữu' END AS ward, CASE c_custkey % 3 WHEN 0 THEN 'Quận Tây' WHEN 1 THEN 'Huyện Đông' END AS district, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, c_custkey % 12 IN (0, 6) AS wrong, concat_ws(', ', nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE ward END), ''), district, n_name, r_name) AS query FROM r""")
def geocode_queries(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    ward, district = F.expr("CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'Xã Tả' WHEN 1 THEN 'Phường Tả' WHEN 2 THEN 'XÃ Hữu' END"), F.expr("CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'Quận Tây' WHEN 1 THEN 'Huyện Đông' END")
    return rows.select("c_custkey", text.wrong_level(district, ward).alias("wrong"), text.geocode_query(F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(ward), district, F.col("n_name"), F.col("r_name")).alias("query"))


@query("SELECT page_id, CASE WHEN contains(url, '/blog') THEN 'blog' WHEN contains(url, 'news') THEN 'news' WHEN contains(url, 'shop') THEN 'shop' ELSE 'other' END AS kind FROM pages")
def slug_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.type_by_slug(F.col("url"), [("/blog", "blog"), ("news", "news"), ("shop", "shop")], "other").alias("kind"))


DATES = _spelled("o_orderkey", ["date_text", None, "'31/02/1995'", "'gestern'", "date_text"])


@query(f"""WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS date_text FROM orders), s AS (SELECT o_orderkey, TRY_STRPTIME({DATES}, '%d/%m/%Y')::DATE AS day FROM r)
SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day, datediff('day', day, DATE '2000-01-01')::INT AS days FROM s""")
def written_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("date_text", F.date_format("o_orderdate", "dd/MM/yyyy")).withColumn("day", text.written_date(F.expr(DATES)))
    return rows.select("o_orderkey", F.col("day").cast("string").alias("day"), F.datediff(F.lit("2000-01-01").cast("date"), "day").alias("days"))


# Reports

STATED = "CASE WHEN row_id % 3 = 0 THEN price / area WHEN row_id % 97 = 1 THEN price / area * 1.05 END"


@query(f"""WITH {LISTING}, s AS (SELECT *, {STATED} AS ppm2, CASE WHEN row_id % 4 = 0 THEN round(price * (1 + (row_id % 5) / 10.0::DOUBLE)) END AS named FROM listing),
g AS (SELECT count(*) AS rows, count(ppm2) AS compared, count(*) FILTER (abs(price / area - ppm2) / ppm2 > 0.01) AS off, avg(coalesce(ppm2, price / area)) AS mean_ppm2, count(named) AS titles, avg((abs(named - price) / price <= 0.15)::INT) AS agreeing FROM s)
SELECT rows, compared, off, off <= 0.01 * rows AS ok, round(mean_ppm2, 2) AS mean_ppm2, titles, round(agreeing, 6) AS agreeing FROM g""")
def parser_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("ppm2", F.expr(STATED)).withColumn("named", F.when(F.col("row_id") % 4 == 0, F.round(F.col("price") * (1 + (F.col("row_id") % 5) / 10.0))))
    gate = market.parser_gate(text.parse_error(F.col("price"), F.col("area"), F.col("ppm2")), rows)
    titles = market.title_agreement(rows, F.col("price"), F.col("named")).select(F.col("compared").alias("titles"), F.round("share", 6).alias("agreeing"))
    mean = market.fill_unit_price(rows).agg(F.round(F.avg("ppm2"), 2).alias("mean_ppm2"))
    return gate.join(F.broadcast(mean)).join(F.broadcast(titles))


LIMITS = {"rooms": 4, "area": 150.0}


@query(f"WITH {LISTING} SELECT 'rooms' AS \"column\", count(*) FILTER (rooms > 4) AS above, sum(CASE WHEN rooms <= 4 THEN rooms END)::DOUBLE AS left_over FROM listing UNION ALL SELECT 'area', count(*) FILTER (area > 150), sum(CASE WHEN area <= 150 THEN area END)::DOUBLE FROM listing")
def physical_limits(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d)
    left = market.within_limits(rows, LIMITS).agg(*(F.sum(c).cast("double").alias(c) for c in LIMITS))
    left = left.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("left_over")) for c in LIMITS))).alias("x")).select("x.*")
    return market.limit_report(rows, LIMITS).join(left, "column")


@query(f"""WITH {LISTING}, c AS (SELECT kind, CASE WHEN starts_with(lower(kind), '1-') THEN '1-' WHEN starts_with(lower(kind), '2-h') THEN '2-H' END AS label FROM listing), l AS (SELECT kind, count(*) AS n FROM c WHERE label IS NULL GROUP BY kind ORDER BY n DESC, kind LIMIT 3)
SELECT count(kind) AS known, count(*) FILTER (label IS NULL) AS lost, round(avg((label IS NULL)::INT), 6) AS share, avg((label IS NULL)::INT) > 0.2 AS alarm, (SELECT string_agg(kind, ',' ORDER BY n DESC, kind) FROM l) AS most_lost FROM c""")
def label_losses(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("label", text.label_by_prefix(F.col("kind"), ["1-", "2-H"]))
    return rounded(market.label_losses(rows, "kind", "label").withColumn("most_lost", F.array_join("most_lost", ",")), 6)


@query(f"""WITH {LISTING}, n AS (SELECT *, count(*) OVER (PARTITION BY ward) AS n_ward, count(*) OVER (PARTITION BY district) AS n_district FROM listing WHERE rooms = 1 AND area < 45)
SELECT row_id, CASE WHEN n_ward >= 30 AND area < 45 AND area < 30 THEN 'high' WHEN n_ward >= 10 OR n_district >= 60 THEN 'medium' ELSE 'low' END AS grade FROM n""")
def grades(spark: SparkSession, d: str) -> DataFrame:
    """Grades of the small one-room listings; a width of the area, widened by a half from 30 on."""
    rows = listing(spark, d).where("rooms = 1 AND area < 45")
    count = lambda c: F.count("*").over(Window.partitionBy(c))
    return rows.select("row_id", valuation.grade(count("ward"), count("district"), F.when(F.col("area") < 30, F.col("area")).otherwise(F.col("area") * 1.5)).alias("grade"))


@query("""WITH c AS (SELECT c_custkey AS id, n_regionkey, row_number() OVER (PARTITION BY c_custkey ORDER BY n_nationkey) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS id FROM orders) SELECT o_orderkey, id, n_regionkey FROM o LEFT JOIN (SELECT id, n_regionkey FROM c WHERE r = 1) USING (id)""")
def attached_places(spark: SparkSession, d: str) -> DataFrame:
    """A table of places by id, with ids that repeat and null ones, beside rows some of which have no id."""
    t = table(spark, d, "customer").where("c_custkey % 3 <> 0").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), "n_regionkey", F.col("n_nationkey").alias("seq"))
    t = t.union(t.withColumn("seq", F.col("seq") + 100).withColumn("n_regionkey", F.lit(-1))).union(t.select(F.lit(None).cast("long"), "n_regionkey", "seq"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("id"))
    return market.attach_by_id(rows, t, "id", "seq").select("o_orderkey", "id", "n_regionkey")


@query()
def merged_batches(spark: SparkSession, d: str) -> DataFrame:
    """The ledger of merging conversation turns as two batches: by id, by a business key, by near texts."""
    turns = spread(table(spark, d, "conversations"), "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    both = turns.select("*", F.lit(0).alias("batch")).union(turns.where("id % 7 = 0").select("*", F.lit(1).alias("batch")))
    both = both.withColumn("row_id", F.col("id") * 2 + F.col("batch")).withColumn("id", F.when(F.col("id") % 3 != 0, F.col("id"))).withColumn("about", F.floor(F.length("text") / 10))
    return market.merge_batches(both, "id", F.concat_ws("|", "role", "text"), "text", ["role", "about"])[1]


# Places

LOST = "CASE WHEN row_id % 5 <> 0 THEN lat END AS lat, CASE WHEN row_id % 5 <> 0 THEN lon END AS lon"


@query(f"""WITH {PLACES}, o AS (SELECT row_id, ward, row_id % 40 AS street, {LOST} FROM places), s AS (SELECT street, ward, median(lat) AS la, median(lon) AS lo FROM o WHERE lat IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), w AS (SELECT ward, median(lat) AS la, median(lon) AS lo FROM o WHERE lat IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT row_id, CASE WHEN lat IS NOT NULL THEN 'pin' WHEN s.la IS NOT NULL THEN 'street' WHEN w.la IS NOT NULL THEN 'ward' END AS level, round(coalesce(lat, s.la, w.la), 6) AS lat, round(coalesce(lon, s.lo, w.lo), 6) AS lon FROM o LEFT JOIN s USING (street, ward) LEFT JOIN w ON o.ward = w.ward""")
def completed_places(spark: SparkSession, d: str) -> DataFrame:
    rows = _lost_places(spark, d)
    out = market.complete_places(rows, rows, [("street", ["street", "ward"]), ("ward", ["ward"])])
    return rounded(out.select("row_id", "level", "lat", "lon"), 6)


def _lost_places(spark: SparkSession, d: str) -> DataFrame:
    lost = F.col("row_id") % 5 == 0
    return places(spark, d).withColumn("street", F.col("row_id") % 40).withColumn("lat", F.when(~lost, F.col("lat"))).withColumn("lon", F.when(~lost, F.col("lon")))


@query(f"""WITH {PLACES}, o AS (SELECT row_id, ward, {LOST} FROM places), l AS (SELECT CASE WHEN lat IS NOT NULL THEN 'own' WHEN count(lat) OVER (PARTITION BY ward) >= 3 THEN 'ward' END AS level FROM o)
SELECT level, count(*) AS n, round(100 * count(*)::DOUBLE / (SELECT count(*) FROM l), 2) AS percent, (SELECT count(*) FROM o WHERE lat IS NULL) AS missing FROM l GROUP BY level""")
def level_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _lost_places(spark, d)
    out = market.level_report(areas.cascade(rows, [("ward", ["ward"])]))
    return out.join(F.broadcast(market.missing_places(rows).select("missing"))).select("level", "n", "percent", "missing")


@query(f"""WITH {PLACES}, c AS (SELECT ward, sum(lat * price) / sum(price) AS lat, sum(lon * price) / sum(price) AS lon, sum(price) AS weight FROM places GROUP BY ward), r AS (SELECT quantile_cont(price, 0.1) AS low, quantile_cont(price, 0.9) AS high, greatest(avg((row_id % 10) / 10.0::DOUBLE), 0.3) AS sigma FROM places)
SELECT ward, round(lat, 6) AS lat, round(lon, 6) AS lon, round(weight, 2) AS weight, round(low, 2) AS low, round(high, 2) AS high, round(sigma, 6) AS sigma FROM c, r""")
def weighted_centres(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    scale = market.colour_range(p, "price").join(F.broadcast(market.smoothing_width(p.withColumn("e", (F.col("row_id") % 10) / 10.0), "e")))
    out = market.weighted_centre(p, "ward", "price").join(F.broadcast(scale))
    return out.select("ward", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "sigma")), *(F.round(c, 2).alias(c) for c in ("weight", "low", "high")))


GRID = f"""g0 AS (SELECT row_id, {X} AS x, {Y} AS y FROM places), a0 AS (SELECT *, count(*) OVER (PARTITION BY floor(x), floor(y)) AS c FROM g0), g1 AS (SELECT x, y FROM a0 WHERE c < 5),
k AS (SELECT DISTINCT 1.0::DOUBLE AS size, floor(x)::BIGINT AS cx, floor(y)::BIGINT AS cy FROM a0 WHERE c >= 5 UNION ALL SELECT DISTINCT 4.0::DOUBLE, floor(x / 4)::BIGINT, floor(y / 4)::BIGINT FROM g1)"""


@query(f"WITH {PLACES}, {GRID} SELECT row_id, min(size) AS size FROM g0 JOIN k ON cx = floor(x / size) AND cy = floor(y / size) GROUP BY row_id")
def cell_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = places(spark, d)
    x, y = geo.plane_km(F.col("lat"), F.col("lon"))
    return market.finest_cell(p.select("row_id", x.alias("x"), y.alias("y")), areas.adaptive_grid(p, sizes=(1.0, 4.0))).select("row_id", "size")


#: A square with a hole, and a polygon of two parts: south, west, north, east.
SQUARES = {0: [(20.75, 105.45, 21.15, 105.85), (20.9, 105.6, 21.0, 105.7)], 1: [(20.6, 105.3, 20.75, 105.6)], 2: [(21.15, 105.7, 21.35, 106.0)]}


def _ring(s: float, w: float, n: float, e: float) -> Column:
    return F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))))


def _inside(box: tuple[float, float, float, float]) -> str:
    s, w, n, e = box
    return f"(lat >= {s} AND lat < {n} AND lon >= {w} AND lon < {e})"


@query(f"""WITH {PLACES}, v AS (SELECT 0 AS polygon, ward FROM places WHERE {_inside(SQUARES[0][0])} AND NOT {_inside(SQUARES[0][1])} UNION ALL SELECT 1, ward FROM places WHERE {_inside(SQUARES[1][0])} OR {_inside(SQUARES[2][0])}),
c AS (SELECT polygon, ward, count(*) AS v FROM v GROUP BY ALL) SELECT polygon::INT AS polygon, arg_min(ward, (-v, ward)) AS name, sum(v)::BIGINT AS n, round(max(v)::DOUBLE / sum(v), 6) AS agreement FROM c GROUP BY polygon HAVING sum(v) >= 3""")
def named_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Wards vote on the names of a square with a hole and of a polygon of two parts."""
    parts = [F.array(F.array(*(_ring(*b) for b in SQUARES[0]))), F.array(*(F.array(_ring(*SQUARES[i][0])) for i in (1, 2)))]
    shapes = F.explode(F.array(*(F.struct(F.lit(i).alias("polygon"), p.alias("parts")) for i, p in enumerate(parts))))
    polygons = spark.range(1).select(shapes.alias("s")).select("s.*")
    return rounded(market.named_polygons(polygons, places(spark, d), "ward"), 6)


# Deals

PRICED = "p AS (SELECT *, median(price) OVER (PARTITION BY ward) AS predicted FROM listing), q AS (SELECT *, 100 * (price / predicted - 1) AS deviation, CASE WHEN price < predicted * 0.5 THEN 'below' WHEN price > predicted * 1.5 THEN 'above' ELSE 'inside' END AS position FROM p)"


def _priced(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).withColumn("predicted", F.median("price").over(Window.partitionBy("ward")))
    return market.position(rows.withColumn("low", F.col("predicted") * 0.5).withColumn("high", F.col("predicted") * 1.5))


@query(f"WITH {LISTING}, {PRICED} SELECT count(*) AS rows, count(*) FILTER (position = 'below') AS below, count(*) FILTER (position = 'above') AS above, count(*) FILTER (position = 'inside') AS inside, round(avg((position = 'inside')::INT), 6) AS covered FROM q")
def position_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.position_counts(_priced(spark, d)), 6)


@query(f"WITH {LISTING}, {PRICED} SELECT row_id, round(deviation, 6) AS deviation FROM q WHERE position = 'below' AND rooms IS NOT NULL ORDER BY q.deviation, row_id LIMIT 30")
def low_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.anomalies(_priced(spark, d), "below", 30, F.col("rooms").isNotNull()).select("row_id", "deviation"), 6)


@query(f"WITH {LISTING}, {PRICED} SELECT row_id, round(deviation, 6) AS deviation FROM q WHERE position = 'above' ORDER BY q.deviation DESC, row_id LIMIT 30")
def high_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.anomalies(_priced(spark, d), "above", 30).select("row_id", "deviation"), 6)


@query(f"WITH {LISTING} SELECT row_id, round(price / area, 6) AS ppm2 FROM listing WHERE price <= 200000 AND rooms >= 2 AND area >= 60 ORDER BY price / area, row_id LIMIT 50")
def affordable_listings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.affordable(listing(spark, d), 200_000, (F.col("rooms") >= 2) & (F.col("area") >= 60)).select("row_id", "ppm2"), 6)


@query(f"""WITH {LISTING} SELECT 'price' AS "column", round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS q50, round(quantile_cont(price, 0.75), 4) AS q75 FROM listing WHERE rooms = 2
UNION ALL SELECT 'area', quantile_cont(area, 0.25), quantile_cont(area, 0.5), quantile_cont(area, 0.75) FROM listing WHERE rooms = 2""")
def result_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(market.quartiles(listing(spark, d).where("rooms = 2"), ["price", "area"]))


@query(f"WITH {LISTING} SELECT floor(price / 20)::BIGINT AS band, min(kind) AS kind FROM listing WHERE kind IS NOT NULL GROUP BY band HAVING count(DISTINCT kind) = 1")
def unambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    return market.unambiguous(listing(spark, d).withColumn("band", F.floor(F.col("price") / 20)), "band", "kind")


@query(f"""WITH {LISTING}, n AS (SELECT ward, count(*) AS n, lower(ward) AS k FROM listing GROUP BY ward), m AS (SELECT ward, n, CASE WHEN k = 'nation_1' THEN 0 WHEN starts_with(k, 'nation_1') OR starts_with('nation_1', k) THEN 1 WHEN contains(k, 'nation_1') OR contains('nation_1', k) THEN 2 END AS match FROM n)
SELECT ward, n, match FROM m WHERE match IS NOT NULL ORDER BY match, n DESC, ward LIMIT 8""")
def found_names(spark: SparkSession, d: str) -> DataFrame:
    return market.find_names(listing(spark, d), "ward", "Nation_1", 8)


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all({_sql_fold('text')}, '[a-z0-9]+')) AS w FROM conversations), n AS (SELECT DISTINCT lang FROM documents UNION SELECT 'de la')
SELECT concat(conv_id, ':', turn) AS row_id, lang AS name FROM w JOIN n ON list_contains(w, lang) UNION SELECT DISTINCT concat(conv_id, ':', turn), 'de la' FROM conversations WHERE regexp_matches({_sql_fold('text')}, '(^|[^a-z0-9])de[^a-z0-9]+la([^a-z0-9]|$)')""")
def names_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Language codes, which are words of some languages, and a name of two words in conversation turns."""
    texts = spread(table(spark, d, "conversations"), "conv_id").withColumn("row_id", F.concat_ws(":", "conv_id", "turn"))
    names = table(spark, d, "documents").select("lang").distinct()
    return market.names_in_texts(texts, names.union(names.limit(1).select(F.lit("de la"))), "row_id", "text", "lang")


@query(r"SELECT page_id, round(TRY_CAST(list_last(regexp_extract_all(html, '\bwidth\s*:\s*[''\"]?(-?[0-9]+(?:\.[0-9]+)?)', 1)) AS DOUBLE), 4) AS width, len(list_distinct(regexp_extract_all(html, '<(h[1-6]|p|div|script|a)\b', 1)))::INT AS kinds FROM pages")
def page_numbers_in_tags(spark: SparkSession, d: str) -> DataFrame:
    """The last number of a script's field, and which tags a page has."""
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.round(html.script_number(h, "width"), 4).alias("width"), F.size(html.tags(h, "h[1-6]", "p", "div", "script", "a")).alias("kinds"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice * 1e4 >= 1e9 THEN printf('%.2f tỷ', o_totalprice * 1e4 / 1e9) ELSE format('{:,} triệu', round_even(o_totalprice * 1e4 / 1e6, 0)::BIGINT) END AS money,
md5(concat_ws('|', round_even(round(o_totalprice * 1e4, 0), -6)::BIGINT, o_custkey % 180, coalesce(CASE WHEN o_custkey % 3 > 0 THEN (o_custkey % 3)::VARCHAR END, ''), substr(o_orderpriority || ' ' || repeat(o_orderstatus, 130), 1, 120))) AS key FROM orders""")
def written_money(spark: SparkSession, d: str) -> DataFrame:
    """Prices as they are written, and the key by which listings are taken for one."""
    price, ward = F.col("o_totalprice") * 1e4, F.when(F.col("o_custkey") % 3 > 0, (F.col("o_custkey") % 3).cast("string"))
    key = text.business_key(F.round(price, 0).cast("long"), F.col("o_custkey") % 180, ward, F.concat("o_orderpriority", F.lit(" "), F.repeat("o_orderstatus", F.lit(130))))
    return table(spark, d, "orders").select("o_orderkey", text.money(price).alias("money"), F.md5(key).alias("key"))


WARDS = "concat('Phường ', split_part(coalesce(source, 'x'), '.', 1), CASE WHEN doc_id % 5 > 0 THEN concat(' ', CAST(doc_id % 5 AS {text})) ELSE '' END)"


@query(rf"""WITH n AS (SELECT nullif(regexp_replace(nullif(trim(regexp_replace({_sql_fold(WARDS.format(text='VARCHAR'))}, '[^a-z0-9]+', ' ', 'g')), ''), '^(?:{'|'.join(text.WARD_PREFIXES)})\s+', ''), '') AS name, CASE WHEN doc_id % 7 > 0 THEN concat('N', length(source) % 5 + CASE WHEN doc_id % 5 = 4 THEN length(source) % 2 ELSE 0 END) END AS new FROM documents),
k AS (SELECT DISTINCT name, new, unnest(list_distinct([name, regexp_replace(name, '\s*\d+$', '')])) AS key FROM n WHERE new IS NOT NULL AND name IS NOT NULL)
SELECT key, min(new) AS new, count(DISTINCT name) AS variants FROM k WHERE length(key) >= 3 GROUP BY key HAVING count(DISTINCT new) = 1""")
def renamed_wards(spark: SparkSession, d: str) -> DataFrame:
    """Old names of wards, spelt from sources with and without numbers, and the new ward that each one and each stem leads to."""
    docs = table(spark, d, "documents").withColumn("old", F.expr(WARDS.format(text="STRING")))
    new = F.concat(F.lit("N"), (F.length("source") % 5 + F.when(F.col("doc_id") % 5 == 4, F.length("source") % 2).otherwise(0)).cast("string"))
    return market.renamed_wards(docs.withColumn("new", F.when(F.col("doc_id") % 7 > 0, new)), "old", "new")


SAID = ["de", "la", "de la", "et de", "les", "que les", "and", "of and the", "the", "of", "und der"]


@query(f"""WITH t AS (SELECT concat(conv_id, ':', turn) AS row_id, regexp_extract_all({_sql_fold('text')}, '[a-z0-9]+') AS w FROM conversations), n AS (SELECT unnest({SAID}) AS name),
r AS (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS start FROM t), h AS (
  SELECT row_id, name, start, len(string_split(name, ' ')) AS words FROM r JOIN n ON array_to_string(w[start:start + len(string_split(name, ' ')) - 1], ' ') = name
) SELECT row_id, name, start::INT AS start, words::INT AS words FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.row_id = a.row_id AND b.words > a.words AND b.start <= a.start AND b.start + b.words >= a.start + a.words)""")
def longest_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that overlap, in conversation turns: where a longer one stands, those inside it do not count."""
    texts = spread(table(spark, d, "conversations"), "conv_id").withColumn("row_id", F.concat_ws(":", "conv_id", "turn"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, SAID))).alias("name"))
    return market.name_spans(texts, names, "row_id", "text", "name")
