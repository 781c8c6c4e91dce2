"""TF-IDF and singular vectors against numpy, and folds that leave no trace of their own texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthline.operators import quality, textmodel, valuation


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    topics = [["house", "garden", "quiet", "lane"], ["flat", "lift", "tower", "view", "Căn", "hộ"], ["plot", "corner", "road", "wide"]]
    out = []
    for i in range(160):
        w = rng.choices(topics[i % 3], k=rng.randint(3, 9)) + rng.choices(topics[rng.randrange(3)], k=2)
        out.append((i, " ".join(w) + (" seldom" if i < 2 else ""), i % 4))
    return out + [(160, None, 0), (161, "", 1), (162, "unheard of", 2)]


def brute(texts, least=3, most=8000):
    terms = []
    for t in texts:
        w = re.findall(r"\b\w\w+\b", (t or "").lower())
        terms.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df, tf = Counter(t for c in terms for t in c), Counter()
    for c in terms:
        tf.update(c)
    names = sorted(sorted((t for t in df if df[t] >= least), key=lambda t: (-tf[t], t))[:most])
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in names}
    m = np.array([[c[t] * idf[t] for t in names] for c in terms])
    return names, idf, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


@pytest.mark.parametrize("most", [8000, 20])
def test_components_equal_a_full_decomposition(spark, rows, most):
    df = spark.createDataFrame(rows, "row_id long, t string, fold int").repartition(3)
    names, idf, m = brute([t for _, t, _ in rows], most=most)
    model = textmodel.fit_text(df, "t", components=6, most=most, rounds=60, close=1e-13)
    assert list(model.terms) == names and model.idf == pytest.approx([idf[t] for t in names])
    u, s, v = np.linalg.svd(m, full_matrices=False)
    assert model.singular == pytest.approx(s[:6], rel=1e-6)
    for k in range(6):
        if min(abs(s[k] - s[j]) for j in range(8) if j != k) > 0.05:
            assert abs(model.loadings[:, k] @ v[k]) == pytest.approx(1, abs=1e-4)
    got = {r.row_id: r for r in model.transform(df, "t").collect()}
    for i, row in enumerate(m):
        assert [got[i][f"txt_{k}"] for k in range(6)] == pytest.approx(row @ model.loadings, abs=1e-9)
    assert got[160].txt_0 == got[161].txt_0 == 0


def test_a_folds_own_texts_change_nothing_of_its_model(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, t string, fold int")
    changed = df.withColumn("t", F.when(F.col("fold") == 1, F.concat(F.lit("brand new words "), "row_id")).otherwise(F.col("t")))
    probe = spark.createDataFrame([(0, "quiet garden flat", 1)], "row_id long, t string, fold int")
    of = lambda d: textmodel.fit_text(d.where("fold <> 1"), "t", components=3).transform(probe, "t").drop("t").first()
    assert of(df) == pytest.approx(of(changed), abs=1e-9)
    out = textmodel.text_components(df, "t", "fold", 4, components=3)
    assert out.columns == ["row_id", "fold", "txt_0", "txt_1", "txt_2"] and out.count() == len(rows)


def test_vocabularies_by_fold_in_one_count(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, t string, fold int")
    got = {(r.fold, r.term): (r.documents, round(r.idf, 9)) for r in textmodel.fold_vocabularies(df, "t", "fold", most=15).collect()}
    want = {}
    for k in range(4):
        for r in textmodel.vocabulary(df.where(f"fold <> {k}"), "t", most=15).collect():
            want[k, r.term] = (r.documents, round(r.idf, 9))
    assert got == want and len(got) == 60


def test_no_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 1)], "row_id long, t string, fold int")
    assert textmodel.fit_text(df, "t").loadings.shape == (0, 0) and textmodel.text_components(df, "t", "fold", 2).columns == ["row_id", "fold"]


def test_text_and_fold_features_in_cross_validation(spark):
    """Prices that only the text tells: its components make the errors smaller; features by fold see the other folds' prices alone."""
    rng = random.Random(2)
    kinds = {"villa": 400.0, "shack": 20.0, "flat": 100.0}
    rows = [(i, kinds[k] * rng.uniform(0.95, 1.05), 50.0 + i % 7, f"{k} for sale {rng.choice(['north', 'south'])} {k}", "a") for i, k in enumerate(rng.choices(list(kinds), k=240))]
    df = spark.createDataFrame(rows, "row_id long, price double, area double, title string, ward string")
    bare = valuation.cross_validated(df, ["area"], ["ward"], folds=2, trees=8, depth=3)
    told = valuation.cross_validated(df, ["area"], ["ward"], folds=2, trees=8, depth=3, text="title", components=3)
    seen = []

    def by_fold(train, test):
        mean = train.agg(F.avg("price").alias("others"))
        seen.append((set(r.row_id for r in train.select("row_id").collect()), set(r.row_id for r in test.select("row_id").collect())))
        return train.join(F.broadcast(mean)), test.join(F.broadcast(mean))

    both = valuation.cross_validated(df, ["area", "others"], ["ward"], folds=2, trees=2, depth=2, by_fold=by_fold)
    assert both.count() == 240 and all(not a & b and len(a | b) == 240 for a, b in seen)
    rates = [valuation.fold_accuracy(x).first() for x in (bare, told)]
    assert rates[1].mape < 20 < rates[0].mape and rates[1].folds == 2 and rates[1].mape_sd >= 0


def test_terms_are_counted_in_small_batches(spark):
    rows = [(i, None if i % 50 == 0 else f"Aa bb{i % 7} bb{i % 7} aa x") for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    got = {r.i: (r.long, [tuple(x) for x in r.terms]) for r in quality.counted_terms(df, "t", "i").collect()}
    assert got[0] == (False, []) and got[1] == (False, [("aa", 2), ("aa bb1", 1), ("bb1", 2), ("bb1 aa", 1), ("bb1 bb1", 1)]) and len(got) == 1000
    made = list(quality._counted(pa.RecordBatch.from_pydict({"i": [i for i, _ in rows], "t": [t for _, t in rows]})))
    assert max(b.num_rows for b in made) <= 256 and sum(b.num_rows for b in made) == 1000  # a worker's memory does not grow with a batch
