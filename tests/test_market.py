"""Keys, polygons, merges and leak-free prices, against worked cases."""

import pytest
from pyspark.sql import functions as F

from hearthline.functions import geo, text
from hearthline.operators import areas, market, quality, quantiles, search, valuation
from hearthline.sources import files, html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("reader, given, want", [
    (text.street_key, "Ngõ 58 Vũ Trọng Phụng", "vu trong phung"), (text.street_key, "Tổ dân phố 5 đường Láng", "lang"), (text.street_key, "Kiệt 5", "kiet 5"), (text.street_key, "Ngõ 12 ngách 3 Kim Mã", "kim ma"),
    (text.street_key, "", None), (text.street_key, None, None), (text.street_key, "!!", None), (text.project_key, "Toà nhà CC The Manor", "the manor"), (text.project_key, "Chung cư Đại Thanh", "dai thanh"), (text.project_key, "Block", None),
    (text.ward_key, "Phường Láng Hạ", "lang ha"), (text.ward_key, None, None), (text.district_key, "Thị xã Sơn Tây", "son tay"), (text.name_key, " ", None),
    (text.html_number, "2,3 tỷ", 2.3e9), (text.html_number, "1.234,5 triệu", 1234.5e6), (text.html_number, "x", None), (text.money, 6.56e9, "6.56 tỷ"), (text.money, 650e6, "650 triệu"),
])
def test_readers(spark, reader, given, want):
    kind = "double" if isinstance(given, float) else "string"
    got = one(spark, reader(F.lit(given).cast(kind)))
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_missing_keys_never_meet(spark):
    rows = spark.createDataFrame([(1, None, 1.0, 1.0), (2, "", 1.0, 1.0), (3, "-", 1.0, 1.0), (4, None, None, None)], "row_id int, street string, lat double, lon double").withColumn("key", text.street_key(F.col("street")))
    assert areas.cascade(rows, [("street", ["key"])]).where("row_id = 4").first().level is None


def test_parts_and_holes_of_polygons(spark):
    wkt = "MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((10 10, 12 10, 12 12, 10 12, 10 10)))"
    parts = files.polygons(F.lit(wkt))
    inside = lambda x, y: one(spark, geo.in_polygons(F.lit(x), F.lit(y), parts))
    assert [inside(*p) for p in ((3.0, 3.0), (1.5, 1.5), (11.0, 11.0), (7.0, 7.0))] == [True, False, True, False]
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 11.0, 11.0), (4, 7.0, 7.0)], "row_id int, lon double, lat double")
    assert {r.row_id for r in areas.contains(points, spark.range(1).select(F.lit(7).alias("polygon"), parts.alias("parts"))).collect()} == {1, 3}
    assert one(spark, F.size(files.polygons(F.lit("POLYGON((0 0, 1 0, 1 1, 0 0))")))) == 1


def test_grades(spark):
    cases = [(30, 0, 44.9, "high"), (30, 0, 45.0, "medium"), (10, 0, 99.0, "medium"), (9, 60, 99.0, "medium"), (9, 59, 1.0, "low")]
    got = spark.createDataFrame(cases, "w int, d int, x double, want string").select(valuation.grade(F.col("w"), F.col("d"), F.col("x")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_outliers_count_rows_and_not_values(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(10, 999.0)] + [(i, None) for i in range(11, 16)], "row_id int, v double")
    assert [r.row_id for r in quantiles.with_iqr_outlier(rows, F.col("v"), [], "o", least=15).where("o").collect()] == [10]


def test_prices_learnt_without_leaks(spark):
    """A category of one row per value carries the price itself: an encoding that saw it would price it well."""
    rows = spark.createDataFrame([(i, float(1000 * (1 + (i * 7919) % 100)), f"c{i}", 1.0) for i in range(300)], "row_id long, price double, own string, size double")
    out = valuation.cross_validated(rows, ["size"], ["own"], folds=3, trees=3, depth=3)
    assert out.count() == 300 and out.where("low > predicted OR high < predicted").count() == 0
    assert valuation.accuracy(out).first().r2 < 0.2
    covered = out.agg(F.avg(F.col("price").between(F.col("low"), F.col("high")).cast("double"))).first()[0]
    assert 0.8 <= covered <= 1.0


def test_one_offset_for_all_rows_equals_sorting(spark):
    for n in (1, 9, 100, 6000):
        values = sorted(float((i * 7919) % 10007) for i in range(n))
        want = values[-(-int((min(-(-(n + 1) * 9 // 10) / n, 1) * (n - 1)) * 1000) // 1000)]
        got = valuation.conformal_offset(spark.createDataFrame([(v,) for v in values], "s double"), "s").first()
        assert got.n == n and abs(values.index(got.offset) - values.index(want)) <= 1


def test_merging_batches(spark):
    long = "a fine flat near the lake with two rooms and a view"
    rows = spark.createDataFrame([(1, "x", "k1", long), (2, "x", "k2", "other words here about a house by the road"), (3, None, "k1", "third text"), (4, None, "k3", long + " !"), (5, None, "k4", None)], "row_id int, id string, k string, t string")
    out, ledger = market.merge_batches(rows.withColumn("b", F.lit(1)), "id", F.col("k"), "t", ["b"], "row_id")
    assert {r.row_id for r in out.collect()} == {1, 5}
    assert [(r.step, r.kept, r.removed) for r in ledger.orderBy("place").collect()] == [("all", 5, 0), ("listing id", 4, 1), ("business key", 3, 1), ("near texts", 2, 1)]


def test_gate_raises(spark):
    rows = spark.createDataFrame([(0.5,), (0.0,), (None,)], "e double")
    with pytest.raises(ValueError, match="1 of 3"):
        market.require_gate(market.parser_gate(F.col("e"), rows))


def test_small_readers_of_sources(spark):
    assert one(spark, files.clean_cell(F.lit("a\x07b"))) == "ab"
    ring = one(spark, files.cell_ring(F.lit(2), F.lit(3), F.lit(0.5)))
    assert [(p.x, p.y) for p in ring] == [(1.0, 1.5), (1.5, 1.5), (1.5, 2.0), (1.0, 2.0), (1.0, 1.5)]
    assert one(spark, text.parse_error(F.lit(100.0), F.lit(10.0), F.lit(8.0))) == 0.25 and one(spark, text.parse_error(F.lit(1.0), F.lit(0.0), F.lit(8.0))) is None
    assert one(spark, text.first_alias(F.lit("Lô GÓC"), [("lo goc", "corner")])) == "corner" and one(spark, text.first_alias(F.lit(None).cast("string"), [("x", "y")])) == "unknown"
    assert one(spark, text.fill_from_text(F.lit(None).cast("double"), F.lit("xây 3 tầng"), text.storeys)) == 3.0
    assert one(spark, quality.outside_band(F.lit(None).cast("double"), 1.0, 2.0)) and one(spark, html.script_number(F.lit("a: 1, a: '2.5'"), "a")) == 2.5


def test_places_are_assigned_by_level(spark):
    schema = "row_id long, lat double, lon double, project string, street string, ward string, new_ward string, district string, listing string"
    reference = spark.createDataFrame([
        (1, 21.01, 105.81, "p", "s", "w", "n", "d", "a"), (2, 21.03, 105.83, "p", "s", "w", "n", "d", "a"), (3, 21.05, 105.85, None, "s", "v", "n", "d", None), (4, None, 105.0, "q", "s", "w", "n", "d", "b"), (5, 21.2, 105.9, None, None, None, None, "e", None),
    ], schema)
    rows = spark.createDataFrame([
        (1, 21.0, 105.8, "p", "s", "w", "n", "d", "a"), (2, 16.0, 108.2, "p", None, None, None, None, "a"), (3, 21.02895, 105.85245, "p", None, None, None, None, None), (4, None, None, "q", "s", "w", "n", "d", "b"),
        (5, None, None, None, "t", "w", "n", "d", None), (6, None, None, None, "s", "z", "n", "d", None), (7, None, None, None, "t", "z", "n", "d", None), (8, None, None, None, "s", "z", None, "d", None),
        (9, None, None, None, "t", "z", None, "e", None), (10, None, None, None, "s", "w", "n", None, None),
    ], schema)
    out = {r["row_id"]: r for r in market.assign_places(rows, reference, listing_id="listing", errors={"own": 0, "street": 0.67}).collect()}
    assert [out[i]["level"] for i in range(1, 11)] == ["own", "id", "project", "street", "ward", "new ward street", "new ward", "district street", "district", None]
    assert [out[i]["support"] for i in range(1, 11)] == [None, 1, 2, 2, 2, 3, 3, 3, 1, None]
    assert (out[2]["lat"], out[3]["lat"], out[6]["lon"], out[9]["lat"], out[10]["lat"]) == (21.01, pytest.approx(21.02), 105.83, 21.2, None)
    assert (out[1]["error_km"], out[4]["error_km"], out[5]["error_km"]) == (0, 0.67, None)
    audit = {r["level"]: r for r in market.audit_places(rows, reference, "listing").collect()}
    assert {k: v["n"] for k, v in audit.items()} == {"project": 2}
    assert market.assign_places(rows.limit(0), reference).count() == 0 and market.assign_places(rows, reference.limit(0)).where("level IS NOT NULL").count() == 1


def test_search_with_all_conditions(spark):
    rows = spark.createDataFrame([(1, 5.0, "N", None, 3, 1), (2, 9.0, None, "N", None, None), (3, 2.0, "S", "S", 8, 0), (4, None, "N", "N", 3, 1)], "row_id long, price double, door_facing string, balcony_facing string, floor int, pool int")
    ids = lambda request: (sorted(r["row_id"] for r in search.find(rows, request)[0].collect()), search.find(rows, request)[1])
    assert ids({}) == ([1, 2, 3], [])
    assert ids({"facing": ["N"]}) == ([1, 2], []) and ids({"not_facing": ["N"]}) == ([3], [])
    assert ids({"floor": (None, 5)}) == ([1], []) and ids({"floor": (5, None)}) == ([3], []) and ids({"floor": (50, None)}) == ([1, 2, 3], ["floor"])
    assert ids({"with": ["pool"], "without": ["pool", "attic"]}) == ([1], ["pool"]) and ids({"without": ["pool"]}) == ([2, 3], [])
    assert ids({"ward": "w", "price_to": 5, "price_from": 3, "project": "p"}) == ([1], ["project", "ward"])
    many = [search.Condition(str(i), F.col("row_id") <= 3 - i % 3) for i in range(30)]
    left, skipped = search.relax(rows, many)
    assert [r["row_id"] for r in left.collect()] == [1] and skipped == []
