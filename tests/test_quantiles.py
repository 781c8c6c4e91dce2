"""Exact quantiles against numpy, with groups that hold most rows, repeats, nulls and rounds of refinement."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import market, quality, quantiles, valuation


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    out = [(i, "hot", rng.gauss(0, 100)) for i in range(3000)] + [(i, "same", 7.0) for i in range(3000, 3500)] + [(i, None, float(rng.randint(0, 9))) for i in range(3500, 3600)]
    return out + [(3600, "one", -1.5), (3601, "none", None), (3602, "hot", None)]


@pytest.mark.parametrize("most,buckets", [(200_000, 256), (40, 4), (5, 3)])
def test_quantiles_of_groups_of_any_size(spark, rows, most, buckets):
    df = spark.createDataFrame(rows, "row_id long, g string, v double").repartition(5)
    wanted = {"low": 0.0, "q18": 0.18, "q50": 0.5, "q99": 0.99, "high": 1.0, "third": lambda n: F.least(n, F.lit(3))}
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", wanted, most=most, buckets=buckets).collect()}
    assert set(got) == {"hot", "same", None, "one"}
    for g, r in got.items():
        values = sorted(v for _, h, v in rows if h == g and v is not None)
        assert r.n == len(values) and r.third == values[min(3, len(values)) - 1]
        for name, q in wanted.items():
            if name != "third":
                assert r[name] == pytest.approx(np.quantile(values, q), abs=1e-9)
    whole = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}, most=most, buckets=buckets).collect()
    assert [(r.n, r.m) for r in whole] == [(3601, pytest.approx(np.median([v for *_, v in rows if v is not None])))]
    assert quantiles.exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).collect() == [(0, None)] and quantiles.exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_no_plan_keeps_a_group_in_a_buffer(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, g string, v double")
    for out in (quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5}), market.quartiles(df, ["v"]), quality.plausible_band(df, F.col("v"), 0, 5), valuation.conformal_offset(df, "v", groups=["g"])):
        assert "percentile" not in out._jdf.queryExecution().toString().lower()


def test_offsets_by_rank(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, g string, v double")
    for groups in (["g"], None):
        for r in valuation.conformal_offset(df, "v", 0.1, groups).collect():
            values = sorted(v for _, h, v in rows if v is not None and (groups is None or h == r.g))
            n = len(values)
            level = min(np.ceil((n + 1) * 0.9) / n, 1.0)
            assert r.n == n and r.offset == np.quantile(values, level, method="higher")


def test_rows_without_a_key_are_all_kept(spark):
    """Half of the rows have no key: they are in no window, and none of them is lost."""
    rows = [(i, None if i % 2 else f"k{i % 10}", i % 7 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, k string, good boolean")
    out = quality.prefer_first(df, "k", F.col("good")).collect()
    assert sum(r.k is None for r in out) == 100 and sorted(r.k for r in out if r.k) == ["k0", "k2", "k4", "k6", "k8"]
    assert all(r.good for r in out if r.k)
    texts = df.select("row_id", "k", F.lit(None).cast("string").alias("b"), F.concat(F.lit("t"), "row_id").alias("t"), F.lit("x").alias("block"))
    kept, ledger = market.merge_batches(texts, "k", F.col("b"), "t", ["block"])
    assert kept.count() == 105 and [r.removed for r in ledger.orderBy("place").collect()] == [0, 95, 0, 0]


def test_encoding_by_fold_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), i % 3, rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, k string, fold int, y double")
    got = {r.row_id: r.enc_k for r in valuation.encode(df, "k", F.col("y"), 10.0, "fold").collect()}
    for i, k, f, _ in rows[:60]:
        others = [(h, y) for _, h, g, y in rows if g != f]
        overall = np.mean([y for _, y in others])
        own = [y for h, y in others if h == k]
        assert got[i] == pytest.approx(overall if k is None else (sum(own) + 10 * overall) / (len(own) + 10))
