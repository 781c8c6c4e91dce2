"""Registered queries of raw listings of two sites, addresses, repaired pins and rebuilt tables, beside the same rows in DuckDB SQL. Texts come in several spellings, with broken and missing ones among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.functions import addresses, text
from hearthline.operators import intake, quality
from hearthline.operators.market import FILLED_IN
from hearthline.plans.market_queries import NUM, SIZES, _spelled, _sql_first_fit, _sql_fold
from hearthline.plans.registry import query
from hearthline.plans.views import LISTING, PLACES, km_sql, listing, places, spread, table
from hearthline.sources import html

# Addresses

SECOND = _spelled("c_custkey", [
    "concat('Đường Láng ', c_custkey, ',  Phường Láng Hạ, Hà Nội (Quận Đống Đa, Hà Nội cũ)')", "concat('The ', c_name, ' Residence, Đường Lê Văn Lương, Phường Thanh Xuân, Hà Nội (Quận Thanh Xuân, Hà Nội  cũ)')",
    "'số 72A, Royal City, ĐƯỜNG  Nguyễn Trãi, Hà Nội'", None, "'  '", "'Khu đô thị Việt Hưng, Xã Gia Lâm'", "'12 Kim Mã'", "c_name", "'Phố Vọng, Phố Vọng, Thị trấn Văn Điển (Huyện Thanh Trì,Hà Nội cũ), Việt Nam'", "', , Hà Nội'", "'Số 5, 7B'",
])


def _sql_re(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


def _sql_second(t: str, key: str, source: str) -> str:
    """Named rows of a source with its address parted: address, new_ward, district, project."""
    return rf"""a0 AS (SELECT *, nullif(trim(regexp_replace({t}, '\s+', ' ', 'g')), '') AS t FROM {source}),
a1 AS (SELECT *, nullif(trim(regexp_extract(t, '{addresses.OLD_DISTRICT}', 1)), '') AS district, regexp_replace(regexp_replace(regexp_replace(t, '{addresses.OLD_DISTRICT}.*$', ''), '[,\s]+$', ''), '{addresses.CITY_AT_END}', '') AS before FROM a0),
a2 AS (SELECT *, nullif(trim(regexp_extract(before, '{addresses.WARD}')), '') AS new_ward, list_filter(list_transform(string_split(regexp_replace(before, '{addresses.WARD}.*$', ''), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM a1),
a3 AS (SELECT *, list_filter(parts, lambda x: regexp_matches(x, '{_sql_re(addresses.STREET)}'))[-1] AS named FROM a2),
a4 AS (SELECT *, list_filter(parts, lambda x: (named IS NULL OR x <> named) AND NOT regexp_matches(x, '{_sql_re(addresses.NUMBERED)}'))[-1] AS project FROM a3),
parted AS (SELECT * EXCLUDE (t, before, parts, named), CASE WHEN t IS NOT NULL THEN concat_ws(', ', coalesce(named, CASE WHEN project IS NULL THEN parts[-1] END), new_ward, district, 'Hà Nội') END AS address FROM a4)"""


@query(f"WITH {_sql_second(SECOND, 'c_custkey', 'customer')} SELECT c_custkey, address, new_ward, district, project FROM parted")
def second_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("a", F.expr(SECOND))
    return rows.select("c_custkey", *(c.alias(n) for n, c in addresses.second_address(F.col("a")).items()))


STREETS = _spelled("c_custkey", ["concat(c_custkey, ', Kim Giang')", "'Lô đất HH1, An Khánh'", "'Lumiere EverGreen'", None, "' , .'", "concat('Số ', c_custkey, '/3B Hào Nam')", "'83, Hào  Nam.'", "'ab'", "'12A - 5, Ngõ 3, Láng'", "'TỔ 7, Phố Vọng'"])
WARDS = _spelled("c_custkey", ["'Phường Thượng Đình'", None, "'XÃ Liên Minh'", "'  '", "'Láng  Hạ'", "'Thị trấn '"])


def _sql_plain(x: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(replace({x}, ',', ' '), '\s+', ' ', 'g')), '{addresses.EDGES}', '', 'g')"


@query(rf"""WITH r AS (SELECT c_custkey, regexp_replace(trim(regexp_replace(coalesce({STREETS}, ''), '\s+', ' ', 'g')), '{addresses.EDGES}', '', 'g') AS raw, nullif(trim(regexp_replace({WARDS}, '{_sql_re(addresses.UNIT)}', '')), '') AS unit FROM customer),
f AS (SELECT *, list_filter(list_transform([regexp_replace(regexp_replace(raw, '{_sql_re(addresses.CLUTTER)}', ''), '{addresses.HOUSE_NUMBER}', ''), regexp_replace(raw, '{addresses.HOUSE_NUMBER}', ''), raw, string_split(raw, ',')[-1]], lambda x: {_sql_plain('x')}), lambda x: length(x) > 2) AS forms FROM r),
c AS (SELECT *, list_filter(forms, lambda x, i: list_position(forms, x) = i)[1:3] AS c FROM f)
SELECT c_custkey, array_to_string(c, '|') AS candidates, array_to_string(list_concat(CASE WHEN unit IS NULL THEN [] ELSE list_transform(c, lambda x: concat_ws(', ', x, unit, 'Hà Nội', 'Việt Nam')) END, list_transform(c, lambda x: x || '/Hà Nội/Việt Nam')), '|') AS asked FROM c""")
def street_queries(spark: SparkSession, d: str) -> DataFrame:
    street, ward = F.expr(STREETS), F.expr(WARDS)
    asked = F.transform(addresses.street_queries(street, ward), lambda q: F.coalesce(q["text"], F.concat_ws("/", q["street"], q["city"], q["country"])))
    return table(spark, d, "customer").select("c_custkey", F.array_join(addresses.street_candidates(street), "|").alias("candidates"), F.array_join(asked, "|").alias("asked"))


UNITS = ["dong da", "cau giay", "thanh tri"]
BROKEN = _spelled("c_custkey", ["'Quận Đống Đa'", "'Quận Uỷ Cầu Giấy'", None, "'Huyện Nào'", "'Quận uỷ'"])
WHOLE = _spelled("c_custkey", ["'Số 5, Phường Láng Hạ, Quận Đống Đa, Hà Nội'", "'Quận ủy, Phường Dịch Vọng, QUẬN Cầu Giấy, Hà Nội'", None, "'Huyện Thanh Trì'", "'Ngõ 3, Quận Lạ'", "''", "'Xã Tân Triều, Huyện Thanh Trì, Hà Nội'"])


def _sql_district(c: str) -> str:
    return rf"nullif(regexp_replace(trim(regexp_replace({_sql_fold(c)}, '[^a-z0-9]+', ' ', 'g')), '^(?:{'|'.join(text.DISTRICT_PREFIXES)})\s+', ''), '')"


@query(rf"""WITH r AS (SELECT c_custkey, {BROKEN} AS said, {WHOLE} AS a FROM customer), p AS (SELECT *, list_transform(string_split(a, ','), lambda x: trim(x)) AS parts FROM r),
k AS (SELECT c_custkey, said, list_filter(parts, lambda x: regexp_matches({_sql_fold('x')}, '^(?:quan|huyen|thi xa)\s+'))[-1] AS again, list_filter(parts, lambda x: regexp_matches({_sql_fold('x')}, '^(?:phuong|xa|thi tran)\s+'))[-1] AS named FROM p),
w AS (SELECT *, {_sql_district('said')} AS said_key, {_sql_district('again')} AS again_key FROM k), m AS (SELECT *, coalesce(said_key NOT IN ({', '.join(f"'{u}'" for u in UNITS)}) AND again_key IN ({', '.join(f"'{u}'" for u in UNITS)}), false) AS mended FROM w)
SELECT c_custkey, CASE WHEN mended THEN again ELSE said END AS district, CASE WHEN mended AND named IS NOT NULL THEN named ELSE 'Phường Cũ' END AS ward, CASE WHEN mended THEN again_key ELSE said_key END AS district_key,
CASE WHEN mended AND named IS NOT NULL THEN regexp_replace({_sql_fold('named')}, '^(?:{'|'.join(text.WARD_PREFIXES)})\s+', '') ELSE 'cu' END AS ward_key, mended FROM m""")
def repaired_units(spark: SparkSession, d: str) -> DataFrame:
    out = addresses.repaired_units(F.expr(BROKEN), F.lit("Phường Cũ"), F.expr(WHOLE), UNITS)
    return table(spark, d, "customer").select("c_custkey", *(c.alias(n) for n, c in out.items()))


# Raw listings

GROUP = "CAST(floor(o_orderkey / 3) AS BIGINT)"
PAPER = _spelled("o_orderkey", ["' Pháp lý Sổ đỏ/ Sổ hồng.'", "' Pháp lý Giấy tờ khác'", "' Pháp lý  Đang chờ sổ'", "''", "' Pháp lý'"])
SLUG = _spelled("o_orderkey", ["'ban-nha-mat-pho'", "'ban-nha-rieng'", "'ban-nha-biet-thu-lien-ke'", "'ban-dat'"])
BLOB = f"concat('Đặc điểm\\n Diện tích  ', o_custkey, ' m²  Mức giá 5 tỷ Số phòng ngủ ', {NUM}, ' phòng', {PAPER}, ' Hướng nhà Đông - Nam Nội thất Full')"
URL = f"CASE WHEN o_orderkey % 31 <> 0 THEN concat('https://site/', {SLUG}, '-x-pr', {GROUP}) END"
SCRIPT = "CASE WHEN o_orderkey % 3 = 1 THEN concat('p = {latitude: ', CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE '21.05' END, ', longitude : 105.', o_orderkey % 90 + 10, '}') WHEN o_orderkey % 3 = 2 THEN 'p = {}' END"
AT = SECOND.replace("c_custkey", "o_custkey").replace("c_name", "o_orderpriority")


@query(rf"""WITH o AS (SELECT *, {URL} AS url, {SCRIPT} AS script, {SLUG} AS slug FROM orders), q AS (SELECT *, nullif(regexp_extract(url, '-pr(\d+)', 1), '') AS listing_id FROM o),
one AS (SELECT * FROM q QUALIFY listing_id IS NULL OR row_number() OVER (PARTITION BY listing_id ORDER BY coalesce(regexp_matches(script, 'latitude\s*:'), false) DESC, o_orderkey) = 1), {_sql_second(AT, 'o_orderkey', 'one')}
SELECT o_orderkey AS row_id, address, new_ward, project, url, listing_id, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 <> 0 THEN 21.05::DOUBLE END AS lat, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 <> 0 THEN ('105.' || (o_orderkey % 90 + 10))::DOUBLE END AS lon,
'Đặc điểm bất động sảnLoại hình' || CASE WHEN url IS NULL THEN 'Nhà ngõ, hẻm' ELSE CASE slug WHEN 'ban-nha-mat-pho' THEN 'Nhà mặt phố, mặt tiền' WHEN 'ban-nha-biet-thu-lien-ke' THEN 'Nhà phố liền kề' ELSE 'Nhà ngõ, hẻm' END END || 'Diện tích' || o_custkey || ' m²' ||
CASE o_orderkey % 5 WHEN 0 THEN 'Giấy tờ pháp lýSổ hồng riêng' WHEN 2 THEN 'Giấy tờ pháp lýĐang chờ sổ' ELSE '' END || 'Số phòng ngủ' || (o_orderkey % 40) || ' phòng' || 'Tình trạng nội thấtNội thất đầy đủHướng cửa chínhĐông Nam' AS attributes, 'second' AS source FROM parted""")
def second_site(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of the second site, three to a listing, only one of them with a script that names a place."""
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("title"), F.expr(AT).alias("address"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("area"), F.expr(BLOB).alias("attributes"), F.lit("x").alias("description"), F.expr(URL).alias("url"), F.expr(SCRIPT).alias("script"))
    return intake.raw_listings(rows, "second", "house").drop("title", "price", "area", "description")


PAGE = "concat({})".format(", ".join([
    "'<html><h1 class=\"t\"> Bán <b>nhà</b> ', o_orderkey, ' </h1><span class=\"re__address-line-1\">Phố Vọng &amp; Láng</span><span class=\"re__address-line-2\">(Xã Gia Lâm, Hà Nội mới)</span>'",
    "CASE WHEN o_orderkey % 3 <> 0 THEN concat('<script>x = {productId: 1, price: 5}; y = {productId: ', o_orderkey, ', price: ', o_custkey, '000, area: 50.5, latitude: 21.5, longitude: 105.25, wardId: 7, cityCode: ''HN''}</script>') ELSE '' END",
    "'<div class=\"re__pr-short-info-item js\"><span class=\"title\">Khoảng giá</span> <span class=\"value\">', o_orderkey % 9 + 1, ',5 tỷ</span></div><div class=\"re__pr-short-info-item\"><span class=\"title\">Mã tin</span><span class=\"value\">', o_custkey, '</span></div>'",
    "'<span class=\"re__pr-specs-content-item-title\">Số phòng ngủ</span><span class=\"re__pr-specs-content-item-value\">', o_orderkey % 6, ' PN</span>'", "'<div class=\"re__detail-content\">Nhà<br>đẹp</div></html>'",
]))


@query("""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS listing_id, 'https://' || o_orderkey AS url, 'Bán nhà ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey * 1000.0::DOUBLE ELSE (o_orderkey % 9 + 1.5)::DOUBLE * 1e9 END AS price, NULL::DOUBLE AS ppm2,
CASE WHEN o_orderkey % 3 <> 0 THEN 50.5::DOUBLE END AS area, CASE WHEN o_orderkey % 3 <> 0 THEN 21.5::DOUBLE END AS lat, CASE WHEN o_orderkey % 3 <> 0 THEN 105.25::DOUBLE END AS lon, CASE WHEN o_orderkey % 3 <> 0 THEN 7::BIGINT END AS ward_id, NULL::BIGINT AS district_id, NULL::BIGINT AS street_id,
NULL::BIGINT AS project_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'HN' END AS city_code, NULL::BIGINT AS product_type, NULL::BIGINT AS category_id, 'Phố Vọng & Láng' AS address, 'Xã Gia Lâm' AS new_ward, NULL::VARCHAR AS posted, NULL::VARCHAR AS expires, NULL::VARCHAR AS tier,
(o_orderkey % 6)::DOUBLE AS bedrooms, NULL::DOUBLE AS bathrooms, NULL::VARCHAR AS facing, NULL::VARCHAR AS balcony, NULL::VARCHAR AS papers, NULL::VARCHAR AS furniture, 'Nhà đẹp' AS description FROM orders""")
def listing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages of listings, a third of them without a script, and what is read from these."""
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    pages = orders.select("o_orderkey", F.expr(PAGE).alias("html"), F.concat(F.lit("https://"), "o_orderkey").alias("url"))
    return html.listing_pages(pages, "html", "url", "o_orderkey")


STOREYS = _spelled("o_orderkey", [f"concat('Nhà ', {NUM}, ' tầng')", "'xây 5 T, ô tô'", "'nhà 4,5 tầng'", None, "'dt 50m2, 3t'", "'tầng 4'", "''"])
FACES = _spelled("o_orderkey", ["'Đông Bắc'", "'đông'", "'ĐÔNG NAM (mát)'", None, "'Giữa'", "''", "'Tây tứ trạch'"])
COMPASS = ["Đông Bắc", "Đông Nam", "Tây Bắc", "Tây Nam", "Đông", "Tây", "Nam", "Bắc"]
#: The same without a lookahead, which DuckDB has none of: the last pattern ends at a sign or the end.
SQL_STOREYS = ([r"(\d{1,2}(?:[.,]5)?)\s*tang\b", r"\bxay\s*(\d{1,2})\s*t\b", r"\b(\d{1,2})\s*t\s*(?:[,.\-–|]|$)"], 1, 20)


@query(f"""WITH s AS (SELECT *, {_sql_fold(STOREYS.replace('STRING', 'VARCHAR'))} AS f, {_sql_fold(FACES)} AS h, (o_custkey % 30 + 1)::DOUBLE AS front, (o_orderkey % 60 + 1)::DOUBLE AS deep, (20 + o_custkey % 180)::DOUBLE AS area FROM orders)
SELECT o_orderkey, {_sql_first_fit('f', SQL_STOREYS)} AS storeys, CASE WHEN o_orderkey % 2 = 0 THEN 2.0::DOUBLE ELSE {_sql_first_fit('f', SQL_STOREYS)} END AS filled, CASE WHEN front <= sqrt(area * 3) THEN front END AS front, CASE WHEN deep <= area / 1.5 THEN deep END AS deep,
CASE {' '.join(f"WHEN starts_with(h, {_sql_fold(repr(c))}) THEN '{c}'" for c in COMPASS)} END AS facing, coalesce(o_totalprice / area < 500 OR o_totalprice / area > 3000, false) AS rejected FROM s""")
def storeys_and_sides(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("*", F.expr(STOREYS).alias("s"), F.expr(FACES).alias("h"), (F.col("o_custkey") % 30 + 1).cast("double").alias("front"), (F.col("o_orderkey") % 60 + 1).cast("double").alias("deep"), (20 + F.col("o_custkey") % 180).cast("double").alias("area"))
    front, deep = text.sane_dimensions(F.col("area"), F.col("front"), F.col("deep"))
    filled = text.fill_from_text(F.when(F.col("o_orderkey") % 2 == 0, 2.0), F.col("s"), text.storeys)
    rejected = quality.outside_band(F.col("o_totalprice") / F.col("area"), 500, 3000)
    return rows.select("o_orderkey", text.storeys(F.col("s")).alias("storeys"), filled.alias("filled"), front.alias("front"), deep.alias("deep"), text.label_by_prefix(F.col("h"), COMPASS).alias("facing"), rejected.alias("rejected"))


# Repaired pins and rebuilt tables


def _pins(spark: SparkSession, d: str) -> DataFrame:
    """Places some of whose pins are the filled-in one, near it, outside the area or missing."""
    n = lambda k: F.col("row_id") % k == 0
    put = lambda c, lake, near, out: F.when(n(11), lake).when(n(13), F.col(c) + out).when(n(17), near).when(~n(19), F.col(c))
    p = places(spark, d)
    return p.select("row_id", put("lat", FILLED_IN[0], FILLED_IN[0] + 0.005, 0.0).alias("lat"), put("lon", FILLED_IN[1], FILLED_IN[1], 2.0).alias("lon"), F.when(~n(23), F.col("ward")).alias("new_ward"), F.when(~n(29), F.col("district")).alias("district"),
                    F.when(n(4), "street").otherwise("own").alias("level"), "price", F.col("row_id").cast("double").alias("road"), F.expr(FACES.replace("o_orderkey", "row_id")).alias("face"))


REPAIRED = f"""{PLACES}, p AS (SELECT row_id, CASE WHEN row_id % 11 = 0 THEN {FILLED_IN[0]}::DOUBLE WHEN row_id % 13 = 0 THEN lat WHEN row_id % 17 = 0 THEN {FILLED_IN[0]}::DOUBLE + 0.005::DOUBLE WHEN row_id % 19 <> 0 THEN lat END AS lat,
CASE WHEN row_id % 11 = 0 THEN {FILLED_IN[1]}::DOUBLE WHEN row_id % 13 = 0 THEN lon + 2.0::DOUBLE WHEN row_id % 17 = 0 THEN {FILLED_IN[1]}::DOUBLE WHEN row_id % 19 <> 0 THEN lon END AS lon, CASE WHEN row_id % 23 <> 0 THEN ward END AS new_ward, CASE WHEN row_id % 29 <> 0 THEN district END AS district,
CASE WHEN row_id % 4 = 0 THEN 'street' ELSE 'own' END AS level, price, row_id::DOUBLE AS road, {FACES.replace('o_orderkey', 'row_id')} AS face FROM places),
l AS (SELECT *, {km_sql('lat', 'lon', f'{FILLED_IN[0]}::DOUBLE', f'{FILLED_IN[1]}::DOUBLE')} AS lake FROM p), w1 AS (SELECT *, CASE WHEN lake < 0.03 THEN 'filled in' WHEN lat IS NOT NULL AND NOT (lat BETWEEN 20.53 AND 21.39 AND lon BETWEEN 105.28 AND 106.03) THEN 'outside' END AS why FROM l),
m1 AS (SELECT district, new_ward, median(lat) AS la, median(lon) AS lo, count(*) AS n FROM w1 WHERE why IS NULL AND lat IS NOT NULL GROUP BY ALL),
w2 AS (SELECT w1.*, CASE WHEN why IS NULL AND {km_sql('w1.lat', 'w1.lon', 'la', 'lo')} > 5 AND n >= 5 AND lake < 1.5 AND level = 'own' THEN 'moved' ELSE why END AS repaired FROM w1 LEFT JOIN m1 USING (district, new_ward)),
m2 AS (SELECT district, new_ward, median(lat) AS la2, median(lon) AS lo2 FROM w2 WHERE repaired IS NULL AND lat IS NOT NULL AND district IS NOT NULL AND new_ward IS NOT NULL GROUP BY ALL), m3 AS (SELECT district, median(lat) AS la3, median(lon) AS lo3 FROM w2 WHERE repaired IS NULL AND lat IS NOT NULL AND district IS NOT NULL GROUP BY ALL),
repaired AS (SELECT row_id, new_ward, district, price, road, face, repaired, CASE WHEN repaired IS NULL THEN lat ELSE coalesce(la2, la3) END AS lat, CASE WHEN repaired IS NULL THEN lon ELSE coalesce(lo2, lo3) END AS lon,
CASE WHEN repaired IS NULL THEN level WHEN la2 IS NOT NULL THEN 'new ward' WHEN la3 IS NOT NULL THEN 'district' END AS level, CASE WHEN repaired IS NULL THEN NULL WHEN la2 IS NOT NULL THEN 2.19::DOUBLE WHEN la3 IS NOT NULL THEN 4.27::DOUBLE END AS error_km FROM w2 LEFT JOIN m2 USING (district, new_ward) LEFT JOIN m3 USING (district))"""


@query(f"WITH {REPAIRED} SELECT row_id, repaired, round(lat, 6) AS lat, round(lon, 6) AS lon, level, error_km FROM repaired")
def repaired_places(spark: SparkSession, d: str) -> DataFrame:
    return intake.repaired_places(_pins(spark, d)).select("row_id", "repaired", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "level", "error_km")


CENTRE = (21.0287, 105.8524)  # the centre that distances are taken from


@query(f"""WITH {REPAIRED}, n AS (SELECT a.row_id, b.price, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km, b.row_id AS other FROM repaired a JOIN repaired b ON a.row_id <> b.row_id AND b.level = 'own' AND a.lat IS NOT NULL AND b.lat IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY km, other) AS rank FROM n), g AS (SELECT row_id, count(*) FILTER (km <= 1.0) AS around, exp(median(ln(price)) FILTER (rank <= 5)) AS near, max(km) FILTER (rank <= 5) AS far FROM r GROUP BY row_id)
SELECT row_id, level, round({km_sql('lat', 'lon', f'{CENTRE[0]}::DOUBLE', f'{CENTRE[1]}::DOUBLE')}, 4) AS centre_km, CASE WHEN road <= 70 THEN road END AS road, CASE {' '.join(f"WHEN starts_with({_sql_fold('face')}, {_sql_fold(repr(c))}) THEN '{c}'" for c in COMPASS)} END AS face_label,
coalesce(around, 0) AS around, round(near, 2) AS near_5, round(far, 4) AS km_5 FROM repaired LEFT JOIN g USING (row_id)""")
def rebuilt_table(spark: SparkSession, d: str) -> DataFrame:
    out = intake.rebuild(_pins(spark, d), CENTRE, {"face": COMPASS}, {"road": 70}, "price", (5,))
    return out.select("row_id", "level", F.round("centre_km", 4).alias("centre_km"), "road", "face_label", "around", F.round("near_5", 2).alias("near_5"), F.round("km_5", 4).alias("km_5"))


NAMES = {"area": "Diện tích", "rooms": "Số phòng ngủ", "ward": "Phường/xã"}


def _sql_plain_number(x: str) -> str:
    return rf"regexp_replace(printf('%.4f', ({x})::DOUBLE), '\.?0+$', '')"


@query(f"""WITH {LISTING}, m AS (SELECT district, median(area) AS typical FROM listing GROUP BY district), r AS (SELECT row_id, area / 7 AS area, rooms, ward, typical / 7 AS typical FROM listing JOIN m USING (district))
SELECT row_id, 'Diện tích ' || {_sql_plain_number('area')} || ' — ' || CASE WHEN area > typical THEN 'lớn hơn' WHEN area < typical THEN 'nhỏ hơn' ELSE 'đúng bằng' END || ' mức phổ biến ' || {_sql_plain_number('typical')} AS area, 'Số phòng ngủ' || coalesce(' ' || rooms, '') AS rooms, 'Phường/xã ' || ward AS ward, 'segment' AS other FROM r""")
def feature_labels(spark: SparkSession, d: str) -> DataFrame:
    """What a reader is shown of each listing's area (beside its district's median), rooms and ward."""
    rows = listing(spark, d)
    rows = rows.join(rows.groupBy("district").agg(F.median("area").alias("typical")), "district").withColumn("area", F.col("area") / 7).withColumn("typical", F.col("typical") / 7)
    none, words = F.lit(None).cast("double"), F.lit(None).cast("string")
    label = lambda name, number=none, said=words, typical=none: intake.feature_label(F.lit(name), NAMES, number, said, typical).alias(name)
    return rows.select("row_id", label("area", F.col("area"), words, F.col("typical")), label("rooms", F.col("rooms")), label("ward", said=F.col("ward")), label("segment").alias("other"))
