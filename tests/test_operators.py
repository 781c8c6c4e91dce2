"""Functions and operators on small inputs, with the cases their sources document."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.functions import geo, text
from hearthline.operators import areas, quality, search, valuation
from hearthline.sources import files, html
from hearthline.streaming import sightings


def values(spark, reader, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r.v for r in df.select("i", reader(F.col("c")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("reader", "cases"),
    [
        (text.vietnamese_number, {"6,558": 6.558, "74.528": 74528.0, "48.9": 48.9, "1.234,56": 1234.56, "12.": 12.0, "": None, ".": None, "1.2.3": None}),
        (text.price, {"6,558 tỷ": 6.558e9, "650 triệu": 650e6, "6.5 tỷ": 65e9, "thương lượng": None, None: None, ",, tỷ": None}),
        (text.price_per_area, {"93,04 triệu/m²": 93.04e6, "1,60 tỷ/m²": 1.6e9, "850.000 đ/m²": 850000.0, "": None}),
        (text.price_hint, {"5,4 tỷ": 5.4e9, "giá 1t7": 1.7e9, "12 tỉ": 12e9, "850tr": 850e6, "x": None}),
        (text.area, {"47 m²": 47.0, "66.12 m²": 66.12, "m²": None}),
        (text.floor, {"căn hộ tầng 12": 12.0, "t12 view": 12.0, "tầng 99": None, "5t5": None, "": None, None: None}),
        (text.storeys, {"nhà 5 tầng": 5.0, "4,5 tầng": 4.5, "xây 5T": 5.0, "25 tầng": None}),
        (text.frontage, {"MT 4m": 4.0, "mặt tiền 4,15m": 4.15, "4m x 12m": 4.0, "45m2 x 5 tầng": None, "mt: 1 m": None}),
        (text.depth, {"4m x 12m": 12.0, "5 x 1 m": None}),
        (text.road_width, {"ngõ rộng 3,5m": 3.5, "đường trước nhà 12 m": 12.0, "ngõ 0,5m": None}),
        (text.street_key, {"Ngõ 58 Vũ Trọng Phụng": "vu trong phung", "1 Phố Bùi Xương Trạch": "bui xuong trach", "Đường Láng": "lang"}),
        (text.project_key, {"Chung cư Đại Thanh": "dai thanh"}),
        (text.facing, {"Đông - Nam": "Đông Nam"}),
        (lambda c: text.address_part(c, r"^quan "), {"Số 1, Phường A, Quận B": "Quận B", "x": None, None: None}),
        (lambda c: text.label_by_prefix(c, ["Sổ", "Sổ hồng"]), {"Sổ hồng riêng": "Sổ hồng", "sổ đỏ": "Sổ", "?": None}),
    ],
)
def test_readers(spark, reader, cases):
    got = values(spark, reader, list(cases))
    assert got == [pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for v in cases.values()]


def test_attributes_take_the_longest_label_and_the_first_value(spark):
    labels = ["Diện tích", "Diện tích đất", "Giá/m²"]
    got = values(spark, lambda c: text.attributes(c, labels), ["xDiện tích đất47 m²Giá/m²9 triệuGiá/m²8Diện tích50", "", None])
    assert got == [{"Diện tích đất": "47 m²", "Giá/m²": "9 triệu", "Diện tích": "50"}, {}, None]


def test_mentions_and_dimensions(spark):
    df = spark.createDataFrame([("Ô tô vào nhà", None, 45.0, 45.0, 31.0), (None, None, None, 4.0, 9.0)], "a string, b string, area double, f double, d double")
    front, deep = text.sane_dimensions(F.col("area"), F.col("f"), F.col("d"))
    got = df.select(*(c.alias(n) for n, c in text.mentions(F.col("a"), F.col("b")).items()), front.alias("front"), deep.alias("deep")).collect()
    assert got[0].mentions_car == 1 and got[1].mentions_car == 0 and got[0].mentions_gym == 0
    assert (got[0].front, got[0].deep, got[1].front, got[1].deep) == (None, None, 4.0, 9.0)


def test_places(spark):
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0))))
    hole = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5))))
    df = spark.createDataFrame([(1.0, 1.0), (0.2, 0.2), (3.0, 1.0), (None, 1.0)], "x double, y double")
    got = df.select(geo.in_ring(F.col("x"), F.col("y"), square).alias("a"), geo.in_polygon(F.col("x"), F.col("y"), F.array(square, hole)).alias("b"), geo.in_box(F.col("y") + 20, F.col("x") + 105).alias("c")).collect()
    assert [r.a for r in got][:3] == [True, True, False] and [r.b for r in got][:3] == [False, True, False] and [r.c for r in got] == [True, False, False, False] or got[0].c
    km = df.limit(1).select(geo.haversine_km(F.lit(21.0), F.lit(105.0), F.lit(22.0), F.lit(105.0)).alias("k")).first().k
    assert km == pytest.approx(math.radians(1) * 6371.0088)


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(1)
    pts = [(i, 20.6 + rng.random() * 0.7, 105.3 + rng.random() * 0.7) for i in range(200)]
    df = spark.createDataFrame(pts, "row_id long, lat double, lon double")
    got = {(r.l_row_id, r.r_row_id): r.km for r in areas.pairs_within(df, df, 6.0).collect()}

    def km(a, b):
        la, lo, lb, lp = map(math.radians, (*a[1:], *b[1:]))
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2))

    want = {(a[0], b[0]): km(a, b) for a in pts for b in pts if km(a, b) <= 6.0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_left_out_medians(spark):
    rng = random.Random(2)
    rows = [(i, i % 4, float(rng.randint(0, 9))) for i in range(30)] + [(99, 9, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, g int, v double")
    got = {r.row_id: r.m for r in areas.with_left_out_median(df, "v", ["g"], "m", buckets=4).collect()}
    for i, g, _ in rows:
        others = [v for j, h, v in rows if h == g and j != i]
        assert got[i] == (pytest.approx(np.median(others)) if others else None)


def test_similar_leaders(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten"
    rows = [(1, "x", a), (2, "x", a + " lambda"), (3, "x", b), (4, "x", a), (5, "y", a), (6, None, a), (7, None, a), (8, "x", None)]
    got = {r.row_id: r.leader for r in quality.similar_leaders(spark.createDataFrame(rows, "row_id long, g string, t string"), ["g"], "t").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8} or got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8}


def test_similar_leaders_of_large_blocks(spark):
    rng = random.Random(4)
    base = [[rng.choice(("nhà", "đẹp", "gần", "chợ", "bán", "gấp", "hẻm", "xe", "hơi", "view", "sông", "lô")) + str(rng.randint(0, 9)) for _ in range(30)] for _ in range(8)]
    def near():
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(30)] = "x" + str(rng.randint(0, 50))
        return " ".join(w)
    rows = [(i, rng.choice(("a", None)), near()) for i in range(200)] + [(900, "a", None), (901, "a", "!"), (902, None, "!"), (903, "s", "kurz und gut"), (904, "s", "kurz und gut"), (905, "t", "alone")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "row_id long, g string, t string")
    lead = lambda most: {r.row_id: r.leader for r in quality.similar_leaders(df, ["g"], "t", most=most).collect()}
    small = lead(800)
    assert 10 < sum(k != v for k, v in small.items()) < 190 and lead(5) == lead(1) == small



def test_relaxation_skips_what_would_leave_nothing(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 9)], "row_id long, w string, p int")
    out, skipped = search.relax(df, [search.Condition("w", F.col("w") == "a"), search.Condition("p", F.col("p") > 7), search.Condition("not 5", F.col("p") != 5, unknown=True)])
    assert [r.row_id for r in out.collect()] == [2] and skipped == ["p"]
    assert search.relax(df, [])[0].count() == 3 and search.relax(df.limit(0), [search.Condition("w", F.col("w") == "a")])[1] == ["w"]


def test_folds_do_not_leak(spark):
    rows = [(i, "abc"[i % 3], float(i)) for i in range(60)] + [(60, None, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, k string, y double").withColumn("fold", valuation.fold_of(F.col("row_id"), 3))
    for r in valuation.encode(df, "k", F.col("y"), fold="fold").collect():
        others = [x for x in df.collect() if x.fold != r.fold]
        overall = np.mean([x.y for x in others])
        own = [x.y for x in others if x.k == r.k]
        want = overall if r.k is None else (sum(own) + 10 * overall) / (len(own) + 10)
        assert r.enc_k == pytest.approx(want)


def test_conformal_rank(spark):
    for n in (1, 5, 19, 100):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "s double")
        level = min(math.ceil((n + 1) * 0.9) / n, 1)
        assert valuation.conformal_offset(df, "s").first().offset == np.quantile(np.arange(n), level, method="higher")


def test_contributions_end_in_the_prediction(spark):
    row = spark.createDataFrame([(1, 2.0, None)], "row_id long, a double, b double")
    got = valuation.contributions(row, {"a": 0.5, "b": 1.0}, {"a": 1.0, "b": 3.0}).orderBy("place").collect()
    assert [r.feature for r in got] == ["a", "b"] and got[-1].step == pytest.approx(math.exp(0.5))


def test_pages(spark):
    page = '<h1>A &amp; <b>B</b></h1><a href="/x-pr12"></a><a href="/x-pr12"></a><script>lat: 20.5, lat: "21.5"</script><dt>k</dt><dd>1</dd><dt>k</dt><dd>2</dd>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    h = F.col("h")
    got = df.select(html.first_tag(h, "h1").alias("t"), html.links(h).alias("l"), html.script_number(h, "lat").alias("n"), html.pairs(h, r"<dt>(.*?)</dt><dd>(.*?)</dd>").alias("p")).collect()
    assert tuple(got[0]) == ("A & B", ["/x-pr12"], 21.5, {"k": "2"}) and tuple(got[1]) == (None, None, None, None) and tuple(got[2]) == (None, [], None, {})
    assert [tuple(r) for r in html.listing_links(df, "h").collect()] == [("12", "/x-pr12")]


def test_files(spark, tmp_path):
    (tmp_path / "dump.sql").write_text("INSERT INTO w VALUES\n('01', 'Ba Đình', 'POLYGON((105.8 21.0, 105.9 21.0, 105.9 21.1, 105.8 21.0))'),\n('02', 'Far', 'POLYGON((1 1, 2 1, 2 2, 1 1))');\n")
    got = files.read_polygon_dump(spark, str(tmp_path), geo.BOX)
    feature = got.select(files.geojson(F.col("polygons")[0], name=F.col("name")).alias("g")).first().g
    assert feature == '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[105.8,21.0],[105.9,21.0],[105.9,21.1],[105.8,21.0]]]},"properties":{"name":"Ba Đình"}}'
    (tmp_path / "a.csv").write_text('id,price\n1,"2,5 tỷ"\n2,\n')
    read = files.read_listings(spark, str(tmp_path / "a.csv"), "id long, price string", ["id"])
    assert [tuple(r) for r in read.collect()] == [(1, "2,5 tỷ"), (2, None)]
    with pytest.raises(ValueError, match="ward"):
        files.require(read, ["ward"])
    hit, miss = files.with_cache(read.select("id"), spark.createDataFrame([(1, None)], "id long, lat double"), "id")
    assert {(r.id, r.cached) for r in hit.collect()} == {(1, True), (2, False)} and [r.id for r in miss.collect()] == [2]


def test_a_stream_of_sightings_equals_the_batch(spark, tmp_path):
    for part, rows in enumerate(([(1, 10, "a"), (2, 11, "b")], [(1, 12, "c"), (3, 9, "d")], [(1, 8, "e")])):
        spark.createDataFrame(rows, "k long, at long, p string").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
        stream = spark.readStream.schema("k long, at long, p string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        sightings.keep_table(stream, "k", "at", "p", f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {tuple(r) for r in sightings.latest(spark, f"{tmp_path}/out", "k").collect()}
    want = {tuple(r) for r in quality.upsert(spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), "k", "at", "p").collect()}
    assert got == want and (1, 8, 12, 3, "c") in got


def test_nearest_at_any_distance(spark):
    rng = random.Random(6)
    pts = [(i, 21 + rng.gauss(0, 0.01), 105.8 + rng.gauss(0, 0.01)) for i in range(60)] + [(100 + i, 21.0, 105.8) for i in range(12)]
    pts += [(200, 12.0, 109.0), (201, -45.0, 179.99), (202, -45.0, -179.99), (203, 90.0, 0.0), (204, 10.0, 106.7)]
    df = spark.createDataFrame([*pts, (300, None, 1.0)], "row_id long, lat double, lon double")
    def far(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.RADIUS_KM * math.asin(math.sqrt(min(1.0, h)))
    for km in (None, 1.0):
        got = {(r.l_row_id, r["rank"]): r.km for r in areas.nearest(df, df, 4, km).collect()}
        want = {(a[0], n): d for a in pts for n, d in enumerate(sorted(d for d in (far(a, b) for b in pts if b[0] != a[0]) if d <= (km or 1e9))[:4], 1)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    few = df.where("row_id >= 203")
    assert sorted((r.l_row_id, r.r_row_id) for r in areas.nearest(few, few, 4).collect()) == [(203, 204), (204, 203)]


def test_left_out_medians_without_whole_groups(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice((0, 0, 0, 1, 2, None)), None if i % 40 == 7 else float(rng.choice((rng.randint(0, 9), rng.randint(0, 500))))) for i in range(400)] + [(900, 9, 1.0), (901, 8, 1.0), (902, 8, 5.0), (903, 7, 1.0), (904, 7, 1.0), (905, 7, 4.0)]
    df = spark.createDataFrame(rows, "row_id long, g int, v double")
    for buckets in (2, 256):
        out = areas.with_left_out_median(df, "v", ["g"], "m", buckets)
        assert "CollectList" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "collect_list" not in plan
        got = {r.row_id: r.m for r in out.collect()}
        for i, g, x in rows:
            others = [v for j, h, v in rows if h == g and j != i and v is not None]
            assert got[i] == (pytest.approx(np.median(others)) if others and x is not None else None)
