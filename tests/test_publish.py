"""Bundles that are whole are served; a leak, another configuration, or any broken part is refused, and the earlier bundle goes on."""

import random
import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from hearthline.operators import publish, valuation

CONFIG = {"numbers": ["area"], "alpha": 0.1}


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(3)
    rows = [(i, 3e4 * (a := rng.uniform(20, 90)) * rng.uniform(0.9, 1.1), a if i % 9 else None, rng.choice(["x", "y", None])) for i in range(250)]
    df = spark.createDataFrame(rows, "row_id long, price double, area double, ward string")
    return df, valuation.fit(df, ["area"], ["ward"], trees=4, depth=3)


def test_publish_and_serve(spark, fitted, tmp_path):
    df, appraiser = fitted
    root = f"{tmp_path}/served"
    assert publish.serve(spark, root, CONFIG) == (None, None, [])
    first = publish.publish(root, df, appraiser, CONFIG)
    found, rows, reasons = publish.serve(spark, root, CONFIG)
    assert not reasons and publish.difference(appraiser.price(df), found.price(rows), "row_id", ["predicted", "low", "high"]) == (0, 0.0)
    assert publish.serve(spark, root, {"alpha": 0.2})[2] == ["1: ValueError: another configuration"]
    # every part of a newer bundle in turn: the first one stays in use
    second = publish.publish(root, df.where("row_id < 200"), appraiser, CONFIG)
    assert publish.serve(spark, root, CONFIG)[1].count() == 200
    for part in ("rows", "appraiser/model", "appraiser/numbers", "appraiser/encoding/ward", "appraiser/train"):
        shutil.move(f"{second}/{part}", f"{tmp_path}/aside")
        served, rows, reasons = publish.serve(spark, root, CONFIG)
        assert rows.count() == 250 and len(reasons) == 1 and served is not None, part
        shutil.move(f"{tmp_path}/aside", f"{second}/{part}")
    df.where("row_id < 200").withColumn("area", F.col("area") + 1).write.mode("overwrite").parquet(f"{second}/rows")
    assert publish.serve(spark, root, CONFIG)[2] == ["2: ValueError: changed: rows"]
    assert first != second


def test_leaks_and_wrong_prices_are_refused(spark, fitted, tmp_path):
    df, appraiser = fitted
    root = f"{tmp_path}/none"
    with pytest.raises(ValueError, match="themselves: predicted"):
        publish.publish(root, df, replace(appraiser, numbers=["area", "predicted"]), CONFIG)
    with pytest.raises(ValueError, match="repeats"):
        publish.publish(root, df.unionByName(df.limit(1)), appraiser, CONFIG)
    odd = replace(appraiser, offset=appraiser.offset.select((F.col("n") * 0).alias("n"), "offset"))  # an offset that does not come back
    with pytest.raises(ValueError, match="other prices"):
        publish.publish(root, df, odd, CONFIG)
    assert publish.serve(spark, root, CONFIG) == (None, None, [])


def test_difference_counts_nulls_and_lone_rows(spark):
    a = spark.createDataFrame([(1, 10.0), (2, None), (3, 5.0), (None, 1.0), (4, None)], "row_id long, v double")
    b = spark.createDataFrame([(1, 10.1), (2, None), (3, None), (None, 1.0), (5, 1.0)], "row_id long, v double")
    odd, gap = publish.difference(a, b, "row_id", ["v"])
    assert odd == 3 and gap == pytest.approx(0.01)
