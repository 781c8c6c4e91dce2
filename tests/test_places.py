"""New wards with provenance, batches, choices, orders, project names, exports: rules and odd rows on small tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthline.functions import projects
from hearthline.operators import places, search
from hearthline.sources import files

ROW = "row_id int, district string, ward string, new_ward string, lat double, lon double"


def test_new_ward_takes_the_first_way_that_works(spark):
    table = spark.createDataFrame([("Quận Đống Đa", "Phường Láng Hạ", "Phường Láng"), ("Quận Đống Đa", "Phường Láng Hạ", "Phường Ô"), ("Huyện Gia Lâm", "Xã Đa Tốn", "Xã Gia Lâm")], "district string, ward string, new_ward string")
    centres = spark.createDataFrame([("Phường Láng", 21.01, 105.81), ("Xã Gia Lâm", 21.02, 105.94)], "centre string, lat double, lon double")
    rows = [
        (1, "Quận Đống Đa", "Phường Láng Hạ", "Xã Gia Lâm", 21.0, 105.8), (2, "quan dong da", "P", "Phường Láng Hạ", None, None), (3, "QUẬN  ĐỐNG ĐA", "láng hạ", None, None, None),
        (4, "Quận Đống Đa", "Xã Láng Hạ", None, 21.02, 105.93), (5, None, None, "Phường Cũ", 21.011, 105.81), (6, None, None, None, None, 105.8), (7, "Huyện Gia Lâm", "Xã Đa Tốn", "", 21.0, 105.0),
    ]
    got = {r.row_id: (r.new_ward, r.new_ward_from, r.new_ward_km, r.ward) for r in places.with_new_ward(spark.createDataFrame(rows, ROW), table, centres).collect()}
    assert got == {
        1: ("Xã Gia Lâm", "given", None, "Phường Láng Hạ"), 2: (None, "unknown", None, "P"), 3: ("Phường Láng", "table", None, "láng hạ"), 4: ("Xã Gia Lâm", "nearest", 1.04, None),
        5: ("Phường Láng", "nearest", 0.11, None), 6: (None, "unknown", None, None), 7: ("Xã Gia Lâm", "table", None, "Xã Đa Tốn"),
    }
    shares = {r.new_ward_from: (r.n, round(r.share, 3)) for r in places.provenance(places.with_new_ward(spark.createDataFrame(rows, ROW), table, centres)).collect()}
    assert shares == {"given": (1, 0.143), "table": (2, 0.286), "nearest": (2, 0.286), "unknown": (2, 0.286)}
    assert places.with_new_ward(spark.createDataFrame([], ROW), table, centres).count() == 0


def test_batches(spark):
    schema = "row_id int, listing_id long, district string, ward string, street string, new_ward string, lat double, lon double"
    near = [(10 + i, 100 + i, "Quận A", "Phường B", "Phố C", "Phường D", 21.0 + i / 1000, 105.8) for i in range(5)]
    first = spark.createDataFrame([*near, (1, 7, "Quận A", "Phường B", "Ngõ 3 Phố C", None, 21.4, 105.8), (2, None, None, None, None, None, 21.5, 105.8)], schema).withColumn("project", F.lit("Chung cư Z"))
    second = spark.createDataFrame([(3, 100, "Quận A", "Phường B", None, None, 21.0, 105.8), (4, None, None, None, None, None, 21.0, 105.9), (5, 8, None, None, None, None, 10.0, 105.8), (6, 9, None, None, None, None, None, 105.8)], schema)
    got = {r.row_id: r for r in places.load_batches([first, second], (20.5, 21.6, 105.2, 106.1)).collect()}
    # 1 is far from its ward, 3 repeats a listing, 5 is outside, 6 has no place; 2 and 4 have no ward to be far from
    assert set(got) == {10, 11, 12, 13, 14, 2, 4}
    assert (got[10].district_key, got[10].ward_key, got[10].street_key, got[10].project_key, got[10].new_ward_key, got[4].project_key) == ("a", "b", "c", "z", "d", None)


def test_choices(spark):
    rows = [(1, "W", "B", "P2", "S", 21.0, 105.0), (2, "W", "A", "P1", "S", 21.0, 105.0), (3, "W", "A", "unknown", "S", None, 105.0), (4, "W", None, "P1", "T", 21.0, 105.0), (5, "V", "A", None, None, 21.0, 105.0), (6, None, "A", "P9", "S", 21.0, 105.0)]
    df = spark.createDataFrame(rows, "row_id int, ward string, district string, project string, street string, lat double, lon double")
    assert {r.ward: (r.district, r.projects, r.streets) for r in places.choices(df, least=2).collect()} == {"W": ("A", ["P1", "P2"], ["S"]), "V": ("A", [], [])}
    assert [(r.project, r.n) for r in places.known_names(df, "project", least=2).collect()] == [("P1", 2)]
    assert [r.row_id for r in places.without_place(df, ["url", "ward"]).collect()] == [3] and places.without_place(df.drop("lat"), ["url"]).count() == 6


def test_orders(spark):
    rows = spark.createDataFrame([(1, 5.0, 50.0, 0.2, "2024-01-01"), (2, 4.0, 40.0, -0.1, "2024-01-02"), (3, None, 50.0, None, "2024-01-03"), (4, 4.0, 90.0, 0.2, "2024-01-03")], "row_id int, price double, area double, deviation double, seen string")
    order = lambda how, request={}: [r.row_id for r in search.arranged(rows, how, request).collect()]  # noqa: E731, B006
    assert order("cheapest") == [4, 2, 1, 3] and order("below") == [2, 4, 1, 3] and order("above") == [4, 1, 2, 3]
    assert order("best", {"price_to": 5.0, "area_from": 50.0}) == [1, 2, 4, 3] and order("best") == [3, 4, 2, 1]
    assert [r.row_id for r in search.arranged(rows.drop("deviation"), "below", {"price_to": 5.0}).collect()] == [1, 4, 2, 3]


def test_around(spark):
    rows = spark.createDataFrame([(1, 21.0, 105.8, 9.0, 90.0, "street"), (2, 21.001, 105.8, 5.0, 10.0, "own"), (3, 21.002, 105.8, None, 50.0, "ward"), (4, 22.0, 105.8, 1.0, 50.0, "own")], "row_id int, lat double, lon double, price double, area double, level string").withColumn("ppm2", F.col("price") / F.col("area"))
    ids = lambda **how: [r.row_id for r in places.around(rows, 21.0, 105.8, 1.0, **how).collect()]
    assert ids() == [1, 2, 3] and ids(by="price") == [2, 1, 3] and ids(by="ppm2") == [1, 2, 3] and ids(by="?") == [1, 2, 3]
    assert ids(most_price=8.0) == [2] and ids(least_area=20) == [1, 3] and ids(levels=["own"]) == [2]


@pytest.mark.parametrize("title, name", [
    ("Bán CHCC HH2C Linh Đàm", "HH Linh Đàm"), ("Linh Đàm", "KĐT Linh Đàm"), ("Vinhomes Smart City, Ocean Park", "Vinhomes Ocean Park"), ("imperia sky garden", "Imperia Sky Garden"), ("Imperial", "Không xác định"),
    ("LUMIÈRE", "Lumière Evergreen"), ("flc  nhà vườn ĐẠI MỖ", "FLC Garden City Đại Mỗ"), (None, "Không xác định"), ("-", "Không xác định"), ("tp giao lưu", "KĐT Thành Phố Giao Lưu"),
])
def test_projects(spark, title, name):
    assert spark.range(1).select(projects.known_project(F.lit(title).cast("string"))).first()[0] == name


def test_export(spark):
    ads = spark.createDataFrame([(5, '{"list_time": 1704067200123, "price": 7, "x": 1}', 1020, 1704067200, 1704153600, 2), (6, "{", 1020, None, 0, 1), (7, '{"list_time": 0}', 1040, 1, 1, 1)], "list_id long, payload string, kind int, first_seen long, last_seen long, times int")
    out = {r.list_id: r for r in files.export_table(ads, {"price": "bigint"}, "https://x/{}.htm").collect()}
    assert out[5].posted == datetime(2024, 1, 1, 0, 0, 0, 123000) and out[5].last_seen == datetime(2024, 1, 2) and out[5].url == "https://x/5.htm" and out[5].price == 7
    assert out[6].first_seen is None and out[6].price is None and out[6].last_seen == datetime(1970, 1, 1) and out[7].posted is None
    assert [r.list_id for r in files.export_table(ads, {"price": "bigint"}, "{}", kind=1040).collect()] == [7]
