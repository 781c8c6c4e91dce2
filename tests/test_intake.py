"""Raw listings of two sites, addresses, repaired pins and rebuilt tables, against worked cases."""

import pytest
from pyspark.sql import functions as F

from hearthline.functions import addresses, geo, text
from hearthline.operators import intake, quality
from hearthline.operators.market import FILLED_IN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [
    ("Đường X, Phường Y, Hà Nội (Quận Z, Hà Nội cũ)", ("Đường X, Phường Y, Quận Z, Hà Nội", "Phường Y", "Quận Z", None)),
    ("số 72A, Royal City, Đường Nguyễn Trãi", ("Đường Nguyễn Trãi, Hà Nội", None, None, "Royal City")), ("360 giải phóng", ("360 giải phóng, Hà Nội", None, None, None)),
    ("Khu đô thị Việt Hưng", ("Hà Nội", None, None, "Khu đô thị Việt Hưng")), ("  ", (None,) * 4), (None, (None,) * 4), (", ,", ("Hà Nội", None, None, None)),
])
def test_second_address(spark, given, want):
    parts = addresses.second_address(F.lit(given).cast("string"))
    assert tuple(spark.range(1).select(*(c.alias(n) for n, c in parts.items())).first()) == want


@pytest.mark.parametrize("given, want", [
    ("2, Kim Giang", ["Kim Giang", "2 Kim Giang"]), ("83, Hào Nam", ["Hào Nam", "83 Hào Nam"]), ("Lô đất HH1, An Khánh", ["An Khánh", "Lô đất HH1 An Khánh"]), ("Lumiere EverGreen", ["Lumiere EverGreen"]), ("", []), (None, []), ("ab", []),
])
def test_street_candidates(spark, given, want):
    assert one(spark, addresses.street_candidates(F.lit(given).cast("string"))) == want


def test_queries_with_a_ward_come_first(spark):
    asked = one(spark, addresses.street_queries(F.lit("2, Kim Giang"), F.lit("Phường Đại Kim")))
    assert [q.text or q.street for q in asked] == ["Kim Giang, Đại Kim, Hà Nội, Việt Nam", "2 Kim Giang, Đại Kim, Hà Nội, Việt Nam", "Kim Giang", "2 Kim Giang"]
    assert [q.text for q in one(spark, addresses.street_queries(F.lit("2, Kim Giang"), F.lit(None).cast("string")))] == [None, None]


@pytest.mark.parametrize("given, want", [("x = {latitude: 21.02, longitude: 105.8}", (21.02, 105.8)), ("latitude: 0, longitude: 0", (None, None)), ("latitude: 21", (None, None)), ("'latitude': 21.0, longitude: 105.0", (None, None)), (None, (None, None))])
def test_script_place(spark, given, want):
    assert tuple(spark.range(1).select(*addresses.script_place(F.lit(given).cast("string"))).first()) == want


def raw(spark, rows):
    return spark.createDataFrame(rows, "row_id long, title string, address string, price string, area string, attributes string, description string, url string, script string")


def test_rows_of_a_listing_become_one_with_its_place(spark):
    blob = "Đặc điểm\nDiện tích 50 m²\n\nPháp lý Sổ đỏ/ Sổ hồng.  Hướng nhà Đông - Nam Mức giá 5 tỷ Nội thất Lạ"
    place = "{latitude: 21.0, longitude: 105.5}"
    rows = raw(spark, [
        (1, "t", "Phố Vọng", "5 tỷ", "50 m²", blob, "d", "https://s/ban-nha-rieng-pr9", "{}"), (2, "t", "Phố Vọng", "5 tỷ", "50 m²", blob, "d", "https://s/ban-nha-rieng-pr9", place),
        (3, None, None, None, None, None, None, None, None), (4, None, None, None, None, "", None, None, place),
    ])
    got = {r.row_id: r for r in intake.second_site(rows, "house").collect()}
    assert set(got) == {2, 3, 4} and (got[2].lat, got[2].lon, got[2].listing_id) == (21.0, 105.5, "9")
    assert got[2].attributes == "Đặc điểm bất động sảnLoại hìnhNhà ngõ, hẻmDiện tích50 m²Giấy tờ pháp lýSổ hồng riêngHướng cửa chínhĐông Nam"
    assert got[3].address is None and got[3].attributes == "Đặc điểm bất động sảnLoại hìnhNhà ngõ, hẻm"
    read = one(spark, text.attributes(F.lit(got[2].attributes), intake.LABEL_ORDER))
    assert read["Giấy tờ pháp lý"] == "Sổ hồng riêng" and read["Diện tích"] == "50 m²"
    assert intake.second_site(rows.drop("url", "script"), "apartment").where("lat IS NULL AND source = 'second'").count() == 4
    assert intake.second_site(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="address, price"):
        intake.second_site(rows.drop("address", "price"))


def test_raw_listings_of_the_first_site(spark):
    got = intake.raw_listings(raw(spark, [(1, "t", "a", "1", "2", "x", "d", "https://s/can-ho/123.htm#px", None)])).first()
    assert (got.listing_id, got.source) == ("123", "first")


def test_distance_to_nowhere_is_unknown(spark):
    assert one(spark, geo.haversine_km(F.lit(None).cast("double"), F.lit(105.0), F.lit(21.0), F.lit(105.0))) is None


def pins(spark):
    near = [(i, 20.8, 105.6, "d", "w", "own") for i in range(6)]
    odd = [
        (10, *FILLED_IN, "d", "w", "own"), (11, 21.0, 106.85, "d", "w", "own"), (12, FILLED_IN[0] + 0.005, FILLED_IN[1], "d", "w", "own"), (13, FILLED_IN[0] + 0.005, FILLED_IN[1], "d", "w", "street"),
        (14, *FILLED_IN, "d", "other", "own"), (15, *FILLED_IN, None, None, "own"), (16, None, None, "d", "w", None), (17, FILLED_IN[0] + 0.005, FILLED_IN[1], "e", "v", "own"),
    ]
    return spark.createDataFrame(near + odd, "row_id long, lat double, lon double, district string, new_ward string, level string")


def test_pins_that_a_site_filled_in(spark):
    got = {r.row_id: r for r in intake.repaired_places(pins(spark)).collect()}
    assert len(got) == 14
    assert {i: got[i].repaired for i in range(10, 18)} == {10: "filled in", 11: "outside", 12: "moved", 13: None, 14: "filled in", 15: "filled in", 16: None, 17: None}
    assert (got[10].lat, got[10].level, got[10].error_km) == (20.8, "new ward", 2.19) and (got[14].lat, got[14].level, got[14].error_km) == (20.8, "district", 4.27)
    assert (got[15].lat, got[15].level, got[15].error_km) == (None, None, None) and got[16].lat is None and got[17].level == "own"
    assert intake.repaired_places(pins(spark).limit(0)).count() == 0


def test_distances_come_after_repairs(spark):
    rows = pins(spark).withColumn("ppm2", F.lit(30.0) + F.col("row_id")).withColumn("road", F.when(F.col("row_id") < 3, 80.0).otherwise(5.0)).withColumn("face", F.lit("Đông Bắc x"))
    got = {r.row_id: r for r in intake.rebuild(rows, FILLED_IN, {"face": ["Đông", "Đông Bắc"]}, {"road": 70}, ks=(2,)).collect()}
    assert len(got) == 14 and got[10].centre_km > 20 and got[16].centre_km is None and got[0].road is None and got[5].road == 5.0 and got[0].face_label == "Đông Bắc"
    assert got[0].near_2 == pytest.approx((31 * 32) ** 0.5) and got[10].near_2 == pytest.approx((30 * 31) ** 0.5) and got[16].near_2 is None


@pytest.mark.parametrize("feature, number, words, typical, want", [
    ("a", 50.0, None, 75.0, "Diện tích 50 — nhỏ hơn mức phổ biến 75"), ("a", 75.5, None, 75.5, "Diện tích 75.5 — đúng bằng mức phổ biến 75.5"), ("a", 100.0, None, None, "Diện tích 100"),
    ("a", 80.0, None, float("nan"), "Diện tích 80"), ("a", None, "Ba Đình", None, "Diện tích Ba Đình"), ("a", None, None, None, "Diện tích"), ("b", 2.0, None, 1.0, "b 2 — lớn hơn mức phổ biến 1"),
])
def test_feature_label(spark, feature, number, words, typical, want):
    assert one(spark, intake.feature_label(F.lit(feature), {"a": "Diện tích"}, F.lit(number).cast("double"), F.lit(words).cast("string"), F.lit(typical).cast("double"))) == want


def test_lineage_is_cut_in_a_checkpoint(spark):
    rows = quality.cut_lineage(spark.range(5))
    assert spark.sparkContext.getCheckpointDir() and rows.count() == 5


def test_upper_case_kinds_are_read(spark):
    parts = text.address_parts(F.lit("Đường Láng, PHƯỜNG Láng Hạ, QUẬN Đống Đa"))
    assert tuple(spark.range(1).select(*parts.values()).first()) == ("Đường Láng", "PHƯỜNG Láng Hạ", "QUẬN Đống Đa")


def test_a_comma_before_the_bracket(spark):
    df = spark.createDataFrame([("Royal City, Đường Nguyễn Trãi, Hà Nội, (Quận Thanh Xuân, Hà Nội cũ)",), ("Royal City, Đường Nguyễn Trãi, Hà Nội (Quận Thanh Xuân, Hà Nội cũ)",)], "t string")
    for r in df.select(*(c.alias(n) for n, c in addresses.second_address(F.col("t")).items())).collect():
        assert (r.project, r.district, r.address) == ("Royal City", "Quận Thanh Xuân", "Đường Nguyễn Trãi, Quận Thanh Xuân, Hà Nội")
