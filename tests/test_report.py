"""The out-of-fold table of boosted prices and the metrics of it, against pandas."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.operators import report


@pytest.fixture(scope="module")
def listings(spark):
    rng = random.Random(12)
    rows = []
    for i in range(360):
        ward, area = rng.choice(["a", "a", "a", "b", "c", None]), rng.uniform(20, 90)
        rows.append((i, "house" if i % 3 else "flat", ward, area, 30 * area * {"a": 1, "b": 2, "c": 3, None: 1.5}[ward] * rng.uniform(0.9, 1.1), i % 5 > 0))
    return spark.createDataFrame([*rows, (999, "flat", "a", 30.0, None, True)], "row_id long, kind string, ward string, area double, price double, sure boolean")


def test_out_of_fold_table_and_its_metrics(listings):
    table = report.out_of_fold(listings, ["area"], ["ward"], folds=3, trees=6, depth=3)
    rows = table.toPandas()
    assert len(rows) == 360 and rows["row_id"].is_unique and rows["predicted"].notna().all() and set(rows["fold"]) == {0, 1, 2}
    assert (rows["deviation"] - 100 * (rows["price"] / rows["predicted"] - 1)).abs().max() < 1e-6
    got = {(r.level, r.key): r for r in report.metrics_report(table, {"all": [], "branch": ["kind"], "ward": ["kind", "ward"]}).collect()}
    rows["e"] = 100 * (rows["predicted"] - rows["price"]).abs() / rows["price"]
    groups = [("all", "all", rows), *(("branch", k, x) for k, x in rows.groupby("kind")), *(("ward", " / ".join(k), x) for k, x in rows.groupby(["kind", "ward"]))]
    assert set(got) == {(a, b) for a, b, _ in groups}
    for level, key, x in groups:
        r = got[level, key]
        inside = x["price"].between(x["low"], x["high"])
        width = 100 * (x["high"] - x["low"]) / 2 / x["price"]
        want = {
            "n": len(x), "mape": x["e"].mean(), "mape_sd": x.groupby("fold")["e"].mean().std(ddof=0), "mae": (x["predicted"] - x["price"]).abs().mean(), "median_error": x["e"].median(), "within_10": 100 * (x["e"] <= 10).mean(),
            "r2": 1 - ((x["predicted"] - x["price"]) ** 2).sum() / ((x["price"] - x["price"].mean()) ** 2).sum(), "covered": 100 * inside.mean(), "inside": inside.sum(), "below": (x["price"] < x["low"]).sum(), "median_width": width.median(),
        }
        for name, v in want.items():
            assert r[name] == pytest.approx(v, rel=1e-6, abs=1e-6), (level, key, name)


def test_branches(listings):
    priced = listings.where("price > 0").withColumns({"fold": (F.col("row_id") % 3).cast("int"), "predicted": F.col("price") * 1.1, "low": F.col("price"), "high": F.col("price") * 2})
    rates = report.metrics_report(priced, {"branch": ["kind"]})
    got = {r.kind: r for r in report.branch_report(priced, rates, "kind", ["ward"], precise=F.col("sure")).collect()}
    rows = priced.toPandas()
    for kind, x in rows.groupby("kind"):
        twins = x.groupby("ward", dropna=False)["price"].agg(["count", "std", "mean"])
        noise = 100 * np.mean(twins["std"] / twins["mean"])
        assert got[kind].precise == pytest.approx(100 * x["sure"].mean()) and got[kind].noise == pytest.approx(noise) and got[kind].gap == pytest.approx(10 - noise)
        counts = x.groupby("ward").size()
        assert (got[kind].wards, got[kind].wards_20, got[kind].wards_under_30) == (len(counts), (counts >= 20).sum(), (counts < 30).sum())


def test_rows_without_predictions(spark):
    empty = spark.createDataFrame(pd.DataFrame({"k": ["a"], "fold": [0], "price": [1.0]})).withColumns({c: F.lit(None).cast("double") for c in ("predicted", "low", "high")})
    assert report.metrics_report(empty, {"all": [], "k": ["k"]}).count() == 0
