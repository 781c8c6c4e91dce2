"""Least squares against numpy, fixed effects against dummies, and Student's t against its integral."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import bundles, regression


@pytest.mark.parametrize("freedom", [1, 2, 5, 30, 4000])
def test_student(freedom):
    x = np.linspace(0, 2.1, 200_001)
    density = np.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi) * (1 + x * x / freedom) ** (-(freedom + 1) / 2)
    inside = 2 * np.sum((density[1:] + density[:-1]) / 2) * (x[1] - x[0])
    assert regression.student_p(2.1, freedom) == pytest.approx(1 - inside, abs=1e-8) and regression.student_p(-2.1, freedom) == regression.student_p(2.1, freedom)
    assert regression.student_p(regression.student_quantile(0.95, freedom), freedom) == pytest.approx(0.05, abs=1e-10)


def solve(x, y, cells):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    freedom = len(y) - x.shape[1]
    noise = np.sum((y - x @ b) ** 2) / freedom
    return b, np.sqrt(noise * np.diag(np.linalg.inv(x.T @ x))), freedom


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(400):
        g, e, a, b = "hot" if i % 4 else "few", rng.choice("pqr"), rng.gauss(1000, 3), rng.gauss(0, 1)
        out.append((i, g, e, a, b, 2 + 0.5 * a - 3 * b + {"p": 0, "q": 50, "r": -9}[e] + rng.gauss(0, 2)))
    return out + [(400, "hot", "p", None, 1.0, 2.0), (401, "lone", "p", 1.0, 2.0, 3.0), *((402 + i, "flat", "p", 1.0, float(i), float(i)) for i in range(9))]


def test_least_squares_by_group(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, g string, e string, a double, b double, y double")
    got = {(r.g, r.name): r for r in regression.least_squares(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")}, ["g"]).collect()}
    for g in ("hot", "few"):
        v = np.array([r[3:] for r in rows if r[1] == g and r[3] is not None])
        b, e, freedom = solve(np.column_stack([v[:, :2], np.ones(len(v))]), v[:, 2], 1)
        for k, name in enumerate(("a", "b", "intercept")):
            r = got[g, name]
            assert (r.n, r.freedom) == (len(v), freedom) and (r.coefficient, r.error) == (pytest.approx(b[k], rel=1e-6), pytest.approx(e[k], rel=1e-6))
            assert r.t == pytest.approx(b[k] / e[k], rel=1e-6) and r.low < r.coefficient < r.high and r.p == pytest.approx(regression.student_p(r.t, freedom), abs=1e-12)
    assert got["lone", "a"].coefficient is None and got["flat", "b"].coefficient is None


def test_fixed_effects_equal_dummies(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, g string, e string, a double, b double, y double").where("g IN ('hot', 'few')")
    got = {r.name: r for r in regression.least_squares(df, F.col("y"), {"a": F.col("a"), "b": F.col("b")}, effects=["e", "g"]).collect()}
    v = [r for r in rows if r[1] in ("hot", "few") and r[3] is not None]
    cells = sorted({(r[2], r[1]) for r in v})
    x = np.array([[r[3], r[4], *((r[2], r[1]) == c for c in cells)] for r in v], float)
    b, e, freedom = solve(x, np.array([r[5] for r in v]), len(cells))
    assert set(got) == {"a", "b"} and got["a"].freedom == freedom
    for k, name in enumerate("ab"):
        assert (got[name].coefficient, got[name].error) == (pytest.approx(b[k], rel=1e-5), pytest.approx(e[k], rel=1e-5))


def test_page_depth_in_per_cent(spark):
    rng = random.Random(3)
    rows = [(i, i % 50, 30.0 + i % 17, 5e7 * 1.005 ** (i % 50) * (30 + i % 17) ** -0.2 * math.exp(rng.gauss(0, 0.05))) for i in range(600)] + [(900, 3, 50.0, 1e9)]
    r = regression.page_depth(spark.createDataFrame(rows, "row_id long, page int, area double, ppm2 double"), F.col("page"), F.col("ppm2"), F.col("area")).first()
    assert r.n == 600 and r.percent_low < 0.5 < r.percent_high and r.p < 1e-6


def test_weights_within_wards(spark):
    """Wards that are dear and near at once: the score counts only inside them. Without a positive weight all are equal."""
    rng = random.Random(8)
    rows = []
    for i in range(500):
        ward, near, quiet = i % 5, rng.random(), rng.random()
        rows.append((i, f"w{ward}" if ward else None, near + ward, quiet, 10.0 * ward + 2 * quiet + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "row_id long, ward string, near double, quiet double, y double")
    apart, whole = bundles.score_weights(df, ["near", "quiet"], "y", within="ward"), bundles.score_weights(df, ["near", "quiet"], "y")
    assert apart["quiet"] > 0.9 > whole["quiet"] and sum(apart.values()) == pytest.approx(1)
    assert bundles.score_weights(df.withColumn("y", -F.col("quiet") - F.col("near")), ["near", "quiet"], "y") == {"near": 0.5, "quiet": 0.5}


def test_resamples_without_repeated_rows(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, x := rng.random(), z := rng.random(), 3 * x + rng.gauss(0, 0.2) + 0 * z) for i in range(400)], "row_id long, a double, b double, y double").repartition(4)
    out = bundles.bootstrap_weights(df, ["a", "b"], "y", times=60)
    again = bundles.bootstrap_weights(df.repartition(2), ["a", "b"], "y", times=60)
    assert out["a"]["measurable"] and not out["b"]["measurable"] and out["a"]["mean"] > 0.9
    assert out["a"]["mean"] == pytest.approx(again["a"]["mean"]) and "Generate" not in df._jdf.queryExecution().toString()
