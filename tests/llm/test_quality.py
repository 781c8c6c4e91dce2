"""Quality from positives and unlabelled text: held-out accuracy, labels that may not matter, the risk, the prior and odd tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthline.llm import quality

from .conftest import words


def junk(rng, w):
    return rng.choice((
        lambda: " | ".join(w), lambda: " ".join(x + rng.choice(("###", "%%", "&&&")) for x in w), lambda: " ".join(x.upper() + "!!" for x in w),
        lambda: " ".join(x for x in w[:12] for _ in range(8)), lambda: "\n".join([" ".join(w[:9])] * 12),
    ))()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(21)
    rows = []
    for i in range(2500):
        w = words(rng, rng.randint(20, 90))
        good = rng.random() < 0.8
        rows.append((i, ". ".join(" ".join(w[k : k + 9]).capitalize() for k in range(0, len(w), 9)) if good else junk(rng, w), int(good)))
    docs = spark.createDataFrame([(i, t, 1.0, "s", 1) for i, t, _ in rows], "doc_id long, text string, score double, x string, quality int").repartition(3)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i % 2], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_accuracy_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    out = [r for r in quality.classify(docs, labels).collect() if r.held_out]
    right = [r.predicted == truth[r.doc_id] for r in out]
    assert len(out) > 400 and sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_no_negative_and_no_held_out_label_is_read(labelled):
    docs, labels, _ = labelled
    scores = lambda x: {r.doc_id: round(r.score, 9) for r in quality.classify(docs, x).collect()}
    as_they_are = scores(labels)
    assert as_they_are == scores(labels.where("quality = 1"))
    assert as_they_are == scores(labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))))


def test_prior_is_near_the_share_of_positives(spark, labelled):
    docs, labels, truth = labelled
    table = docs.toPandas()
    x = quality.features(pa.RecordBatch.from_pydict({"t": pa.array(table["text"])}), "t")
    rows = [(bytearray(v.tobytes()), bool(truth[i] and i % 2)) for v, i in zip(x, table["doc_id"])]
    _, prior = quality.learn(spark.createDataFrame(rows, "x binary, positive boolean"))
    assert abs(prior - 0.8) < 0.08


def test_risk_is_never_below_zero_and_least():
    """The closed form is the least of the unbiased risk where that is not negative; where it is, the fit's risk is no worse than that of other weights."""
    rng = np.random.default_rng(2)
    for few in (400, 12):
        p = np.column_stack([np.ones(few), rng.normal(1, 1, (few, 10))])
        u = np.column_stack([np.ones(500), np.concatenate([rng.normal(1, 1, (300, 10)), rng.normal(-1, 1, (200, 10))])])
        s = quality.Sums(500, few, u.mean(0), u.T @ u / 500, p.mean(0), p.T @ p / few)

        def risks(w, prior=0.6):
            loss = lambda x, y: np.mean((x @ w - y) ** 2)  # noqa: B023, E731
            return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)  # noqa: B023

        w = quality.fit(s, 0.6)
        total = lambda w: risks(w)[0] + max(0, risks(w)[1]) + 1e-4 * w @ w  # noqa: B023, E731
        assert risks(w)[1] > -1e-6 and (few > 100) == (risks(w)[1] > 1e-6)
        assert all(total(w) <= total(w + rng.normal(0, size, len(w))) + 1e-9 for size in (1e-3, 0.01, 0.1, 1) for _ in range(100))


def test_prior_from_scores_of_separate_classes():
    good, bad = np.zeros(100), np.zeros(100)
    good[60:], bad[:50] = 1000, 400
    assert abs(quality.prior_from_scores(good, 2 * good + 2 * bad) - 80_000 / 120_000) < 0.01
    assert quality.prior_from_scores(np.zeros(5), np.ones(5)) == 0.5


def test_features_do_not_depend_on_batches(texts):
    of = lambda t: quality.features(pa.RecordBatch.from_pydict({"t": pa.array(t, pa.string())}), "t")
    whole = of(texts)
    assert np.array_equal(whole, np.concatenate([of([t]) for t in texts])) and ((whole >= 0) & (whole <= 1)).all()
    assert not whole[[i for i, t in enumerate(texts) if not t]].any()
    assert of([]).shape == (0, len(quality.FEATURES))


def test_odd_tables(docs, nothing, labelled):
    _, labels, _ = labelled
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).where("score > 0 OR predicted > 0").count() == 0
    out = quality.classify(docs, labels.unionByName(labels.limit(3)))
    assert out.count() == docs.count() and out.columns == ["doc_id", "held_out", "score", "predicted"] and out.where("doc_id IS NULL AND held_out").count() == 0
