"""What keeps work in step with the input: operators that read their rows once, and counts that need no pairs of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import appraisal, areas, market, quantiles, report, valuation


def test_places_of_dense_cells_are_not_compared(spark, monkeypatch):
    compared = []
    whole = areas.pairs_within
    monkeypatch.setattr(areas, "pairs_within", lambda left, right, km: compared.append(left.count()) or whole(left, right, km))
    rng = np.random.default_rng(5)
    near = [(i, 21.0 + float(a) / 5000, 105.8 + float(b) / 5000) for i, (a, b) in enumerate(rng.uniform(0, 1, (1500, 2)))]
    # one beside the dense ones, four far away that are near to one another, and rows without a place
    far = [(2000, 21.005, 105.8)] + [(2001 + i, 21.3, 105.5 + i / 5000) for i in range(4)] + [(2010, None, 105.8), (2011, float("nan"), 105.8)]
    got = {r.row_id for r in areas.dense_pins(spark.createDataFrame(near + far, "row_id long, lat double, lon double"), km=1.0, least=5, places=6).select("row_id").collect()}
    assert got == {i for i, *_ in near} | {2000}
    assert compared[0] <= 10


def test_cuts_below_a_value(spark):
    cuts = [-3.0, 0.0, 0.0, 1.5, 7.0, 7.0, 9.0]
    values = [-5.0, -3.0, -1.0, 0.0, 1.0, 1.5, 6.9, 7.0, 8.0, 9.0, 10.0]
    df = spark.createDataFrame([(v, cuts) for v in values] + [(1.0, None)], "v double, cuts array<double>")
    got = [r.part for r in quantiles._cuts_below(df, "cuts", "v", 255, "part").collect()]
    assert got == [*np.searchsorted(cuts, values, "left"), 0]


def _listings(spark):
    return spark.range(400).select(
        F.col("id").alias("row_id"), F.concat(F.lit("w"), F.col("id") % 3).alias("ward"), F.concat(F.lit("d"), F.col("id") % 2).alias("district"), (100 + F.col("id") % 40).cast("double").alias("price"),
        (F.col("id") % 4).cast("int").alias("fold"), F.lit(120.0).alias("predicted"), F.lit(90.0).alias("low"), F.lit(130.0).alias("high"),
    )


@pytest.mark.parametrize("made", [
    lambda df: areas.ward_table(df), lambda df: report.metrics_report(df, {"all": [], "branch": ["district"]}),
    lambda df: report.branch_report(df, df.select(F.lit("none").alias("level"), F.lit("").alias("key"), F.lit(0.0).alias("mape"), F.lit(0.0).alias("r2"), F.lit(0.0).alias("covered")).limit(0).localCheckpoint(), "district", ["ward"]),
], ids=["ward_table", "metrics_report", "branch_report"])
def test_rows_are_read_once(spark, made):
    out = made(_listings(spark))
    assert "Range (0, 400" not in out._jdf.queryExecution().analyzed().toString()
    assert out.count() > 0


def test_trees_are_fitted_by_many_tasks(spark):
    """A file of one part, and categories of a few keys: the rows that trees pass over are dealt by their number, alike in every run."""
    rows = spark.range(0, 45_000, 1, 1).select(F.col("id").alias("row_id"), (F.col("id") % 50).cast("double").alias("size"), F.concat(F.lit("b"), F.col("id") % 3).alias("brand"))
    rows = rows.withColumn("price", 10 + F.col("size") * (1 + F.col("row_id") % 3))
    a = valuation.fit(rows, ["size"], ["brand"], trees=2, depth=2)
    assert a.train.rdd.getNumPartitions() == 2 and a.train.count() == rows.where(valuation.fold_of(F.concat(F.lit("c"), F.col("row_id").cast("string")), 4) != 0).count()
    again = valuation.fit(rows.repartition(5), ["size"], ["brand"], trees=2, depth=2)
    assert again.model.toDebugString.split("\n", 1)[1] == a.model.toDebugString.split("\n", 1)[1]


def _pinned(spark):
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 11 == 0 else f"w{i % 3}", i % 2, None if i % 7 == 0 else float(a), None if i % 13 == 0 else float(b)) for i, (a, b) in enumerate(rng.uniform(20, 22, (300, 2)))]
    return rows, spark.createDataFrame(rows, "row_id long, ward string, district int, lat double, lon double")


def test_median_places_of_any_size(spark):
    rows, df = _pinned(spark)
    wards, both, districts = quantiles.median_places(df, [["ward"], ["district", "ward"], ["district"]], most=4, buckets=4)
    for got, keys in ((wards, [1]), (both, [2, 1]), (districts, [2])):
        cells = {}
        for r in rows:
            if all(r[k] is not None for k in keys) and r[3] is not None and r[4] is not None:
                cells.setdefault(tuple(r[k] for k in keys), []).append(r[3:])
        want = {k: (*np.median(v, axis=0), len(v)) for k, v in cells.items()}
        found = {tuple(r)[: len(keys)]: tuple(r)[len(keys):] for r in got.collect()}
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    assert quantiles.median_places(df, []) == []


@pytest.mark.parametrize("made", [
    lambda df: market.place_table(df, ["ward"], F.col("row_id") > 5), lambda df: market.complete_places(df, df, [("ward", ["district", "ward"])]), lambda df: market.assign_places(df, df, [("ward", ["ward"])]),
    lambda df: areas.cascade(df, [("ward", ["ward"])]), lambda df: market.audit_places(df, df, "row_id", [("ward", ["ward"])]),
], ids=["place_table", "complete_places", "assign_places", "cascade", "audit_places"])
def test_medians_of_places_hold_no_group(spark, made):
    out = made(_pinned(spark)[1])
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "median(" not in plan and "percentile(" not in plan
    assert out.count() > 0


def _poi_features(rows, poi, kinds, km):
    """Counts and nearest by comparing all pairs."""
    def away(a, b):
        la, lo, lb, lp = (np.radians(v) for v in (a[0], a[1], b[0], b[1]))
        return 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2, 1)))

    out = {}
    for i, *at in rows:
        each = []
        for k in kinds:
            near = [] if None in at or np.isnan(at).any() else [d for kind, *b in poi if kind == k and None not in b and (d := away(at, b)) <= km]
            each += [min(near, default=None), len(near)]
        out[i] = each
    return out


@pytest.mark.parametrize("km", [0.5, 8.0, 30.0])
def test_points_of_interest_equal_brute_force(spark, monkeypatch, km):
    monkeypatch.setattr(areas, "CHUNK", 50)
    monkeypatch.setattr(areas, "GROUP", 8)
    rng = np.random.default_rng(9)
    rows = [(i, 21.0 + float(a) / 10, 105.8 + float(b) / 10) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))]
    # equal places, the date line, the far north, a pole, and rows without a place
    rows += [(300 + i, *rows[i][1:]) for i in range(5)] + [(400, 10.0, 179.99), (401, 69.0, 20.0), (402, 90.0, 0.0), (403, None, 105.8), (404, float("nan"), 105.8), (405, -33.0, -70.0)]
    poi = [(f"k{i % 3}", 21.0 + float(a) / 10, 105.8 + float(b) / 10) for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))]
    poi += [*poi[:4], ("k0", *rows[0][1:]), ("k0", 10.0, -179.99), ("k1", 69.0, 20.15), ("k2", 89.97, 180.0), ("k1", None, 1.0), ("other", 21.0, 105.8), (None, 21.0, 105.8), ("k0", -33.0, -70.05)]
    kinds = ("k0", "k1", "k2", "none")
    out = areas.poi_features(spark.createDataFrame(rows, "row_id long, lat double, lon double"), spark.createDataFrame(poi, "kind string, lat double, lon double"), kinds, km)
    assert out.columns == ["row_id", *(f"{c}_{k}" for k in kinds for c in ("near", "count"))]
    got, want = {r[0]: list(r[1:]) for r in out.collect()}, _poi_features(rows, poi, kinds, km)
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i] == [v if v is None else pytest.approx(v, abs=1e-9) for v in row]


def test_points_within_a_circle_are_not_compared(monkeypatch):
    """Of places and points in one small patch all pairs are within km: whole groups count, and distances are taken for the nearest alone, in step with the rows and not with their pairs."""
    compared = []
    whole = areas._haversine
    monkeypatch.setattr(areas, "_haversine", lambda a, b: compared.append(len(a)) or whole(a, b))
    rng = np.random.default_rng(3)

    def at(n):
        lat, lon = 21 + rng.uniform(0, 0.03, n), 105.8 + rng.uniform(0, 0.03, n)
        a, b = np.radians(lat), np.radians(lon)
        return np.column_stack([lat, lon, *(areas.RADIUS_KM * (1 + c) for c in (np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)))])

    totals = []
    for n in (4000, 16000):
        around = areas._Around(at(n), 2, 8.0)
        around.see(np.arange(2 * n) % 2, np.ones(2 * n, np.int64), at(2 * n))
        assert (around.count == n).all() and (around.near < 1.0).all()
        totals.append(sum(compared))
        compared.clear()
    assert totals[1] < 6 * totals[0]  # 4 times the rows, 16 times the pairs


def test_neighbours_are_counted_at_every_latitude(spark):
    """69 degrees north and beside the date line, where cells of a plane lie further apart than places do."""
    rows = [(1, 69.0, 20.0, 2.0), (2, 69.0, 20.022, 3.0), (3, 10.0, 179.998, 2.0), (4, 10.0, -179.998, 4.0), (5, None, 20.0, 2.0), (6, 69.0, 20.0, None)]
    df = spark.createDataFrame(rows, "row_id long, lat double, lon double, ppm2 double")
    assert {r.row_id: r.around for r in appraisal.neighbour_prices(df, df, (1,)).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 2}
