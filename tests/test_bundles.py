"""Bundles, what-if tables and weights."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hearthline.operators import bundles


def test_bundle_is_loaded_or_rejected(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"), LinearRegression(featuresCol="f", labelCol="y")]).fit(df)
    config = {"b": 1, "a": [1, 2]}
    path = f"{tmp_path}/bundle"
    assert bundles.load_bundle(spark, path, config).startswith("no manifest")
    bundles.save_bundle(path, model, df, config)
    loaded, encoders = bundles.load_bundle(spark, path, {"a": [1, 2], "b": 1})
    assert encoders.count() == 10 and loaded.transform(df.where("x = 3")).first().prediction == pytest.approx(6.0)
    assert bundles.load_bundle(spark, path, {"a": [2, 1], "b": 1}) == "another configuration"
    assert bundles.data_fingerprint(df, ["x"]) == bundles.data_fingerprint(df.orderBy(F.desc("x")), ["x"]) != bundles.data_fingerprint(df.limit(9), ["x"])


def test_what_if_and_compare(spark):
    row = spark.createDataFrame([(7, 2, 50.0, "a", "w", "d")], "row_id int, rooms int, area double, kind string, ward string, district string")
    price = lambda df: df.withColumn("predicted", 100 * F.col("area") * (1 + F.col("rooms")) + F.when(F.col("kind") == "b", 5000).otherwise(0))
    known = [(2, 50.0, "b", "w", "d")] * 12 + [(3, 50.0, "a", "x", "d")] * 40 + [(3, 60.0, "c", "w", "e")] * 5 + [(2, 1.0, "a", None, None)] * 3
    known = spark.createDataFrame(known, "rooms int, area double, kind string, ward string, district string")
    got = [(r.feature, r.now, r.value, r.change, r.n, r.trust) for r in bundles.what_if(row, {"rooms": [2, 3], "area": [60.0], "kind": ["b", "c"]}, price, known).collect()]
    # the ward has 17 listings, so the district's 52 are asked
    assert got == [("rooms", "2", "3", 33.3, 40, "enough"), ("kind", "a", "b", 33.3, 12, "some"), ("area", "50.0", "60.0", 20.0, 0, "few"), ("kind", "a", "c", 0.0, 0, "few")]
    none = row.withColumn("ward", F.lit(None).cast("string")).withColumn("rooms", F.lit(None).cast("int"))
    assert {(r.value, r.n) for r in bundles.support_of(none.withColumn("district", F.lit(None).cast("string")), {"rooms": [2, 3]}, known, "row_id").collect()} == {("2", 15), ("3", 45)}
    assert [(r.now, r.value, r.change) for r in bundles.what_if(none, {"rooms": [2]}, price).collect()] == [(None, "2", None)]
    a, b = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "feature string, share double"), spark.createDataFrame([("x", 4.0)], "feature string, share double")
    assert {r.feature: r.gap for r in bundles.compare(a, b).collect()} == {"x": 3.0, "y": -2.0}


def test_weights_equal_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = x @ [2.0, 1.0, -3.0] + rng.normal(0, 0.05, 400)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id long, a double, b double, c double, y double")
    z = (x - x.mean(0)) / x.std(0)
    w = np.maximum(np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())), 0)
    got = bundles.score_weights(df, ["a", "b", "c"], "y")
    assert list(got.values()) == pytest.approx(list(w / w.sum()), rel=1e-6)
    boot = bundles.bootstrap_weights(df, ["a", "b", "c"], "y", times=40)
    assert boot["a"]["measurable"] and not boot["c"]["measurable"] and boot["c"]["zero"] == 1.0 and boot["a"]["low"] <= got["a"] <= boot["a"]["high"]
    assert bundles.bootstrap_weights(df.limit(0), ["a"], "y") == {} and bundles.score_weights(df.limit(0), ["a"], "y") == {"a": 0.0}
