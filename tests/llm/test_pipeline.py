"""The stages of the pipeline, each against brute force on what it was given."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from hearthline.llm import mixing, pii, tiling, toxicity
from hearthline.llm.words import word_hashes, word_spans

from .conftest import COLUMNS, changed, words
from .test_duplicates import brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    bad, items = ["snivel", "gruntle"], [" ".join(words(rng, 30)) for _ in range(3)]
    rows, labels = [], []
    base = words(rng, 80)
    for i in range(300):
        w = changed(rng, base, 0.01) if i % 10 == 0 else words(rng, rng.randint(10, 60))
        toxic = i % 6 == 5
        if toxic:
            w.insert(3, rng.choice(bad))
        if i % 25 == 1:
            w += items[i % 3].split()
        if i % 15 == 2:
            w.insert(2, f"u{i}@mail.example.com")
        rows.append((i, " ".join(w), "en", ("hot", "b", None)[min(i % 5, 2)], 0, "x", 1, "c", "k", 2, "r", 3))
        labels.append((i, 1, int(toxic)))
    # rows without an id: toxic, contaminated, a copy, and one that stays
    rows += [(None, f"{' '.join(words(rng, 20))} {x}", "en", "b", 0, *[None] * 7) for x in (" ".join(bad), items[0])] + [(None, rows[1][1], "en", "b", 0, *[None] * 7)]
    rows += [(1000, None, None, None, None, *[None] * 7), (1001, "", "en", "b", 0, *[None] * 7), (None, "no id " * 20, "en", "b", 0, *[None] * 7), rows[3]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def tokens(text):
    data = tiling.PLAIN[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def test_every_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [tokens(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "personal data", "mixing"]

    def take(name, df):
        out = spark.createDataFrame(stages[name](spark, df, folder).collect(), df.schema if name != "mixing" else None) if name != "mixing" else stages[name](spark, df, folder)
        assert out.columns[: len(df.columns)] == df.columns
        return out

    lexicon = toxicity.learn_from_labels(docs, labels)
    machine = lexicon.automaton()
    gone = [r for r in docs.collect() if lexicon.score(machine, r.text) >= 0.7]
    a = take("toxicity", docs)
    assert ids(a) == ids(docs) - Counter(r.doc_id for r in gone) and len(gone) > 30 and any(r.doc_id is None for r in gone)

    key = lambda r: (10**6 + sum(map(ord, r.text or ""))) if r.doc_id is None else r.doc_id
    component = brute_components([(key(r), r.text) for r in a.collect()], 80)
    b = take("near duplicates", a)
    assert ids(b) == Counter(r.doc_id for r in a.collect() if component[key(r)][1] == key(r))
    assert ids(b)[None] == ids(a)[None] - 1
    assert b.count() < a.count()

    def leaks(text):
        t = tokens(text)
        return any(sum(k for _, _, k in tiling.tiles(i, t, 4)) >= len(i) / 2 for i in items)

    c = take("decontamination", b)
    assert ids(c) == Counter(r.doc_id for r in b.collect() if not leaks(r.text)) and ids(c)[None] == ids(b)[None] - 1
    large = tiling.clean(b, spark.read.parquet(f"{folder}/benchmark.parquet"), most_words=0)
    assert ids(large) == ids(c) and large.columns == b.columns
    named = b.selectExpr("*", *(f"1 AS {c}" for c in ("_of", "of", "_gone", "gone", "key", "text_", "seed", "hits")))
    for most in (0, 1 << 20):
        same = tiling.clean(named, spark.read.parquet(f"{folder}/benchmark.parquet"), most_words=most)
        assert ids(same) == ids(c) and same.columns == named.columns

    d = take("personal data", c)
    assert ids(d) == ids(c)
    before = {r.doc_id: r.text for r in c.collect()}
    for r in d.collect():
        assert all((before[r.doc_id] or "")[s:e] not in r.text for _, s, e in pii.base_spans(before[r.doc_id] or ""))
        assert r.text == before[r.doc_id] or "[" in r.text
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert any("[EMAIL]" in (r.text or "") for r in d.collect())

    want = Counter()
    for r in mixing.mix(d).collect():
        if r.copies:
            want[r.doc_id] += r.copies
    assert ids(take("mixing", d)) == want


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*COLUMNS.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "copy_"]
    assert out.count() > 100
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(spark, nothing, folder):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name
