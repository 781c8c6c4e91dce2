"""Spelling variants against brute force, with sort ranges that share trie nodes, long runs and odd tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthline.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, least=3, shortest=5):
    """The rows, straight from the definition."""
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = 1 if i is None else zlib.crc32(f"{i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if k >= least and len(w) >= shortest}
    beside = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(b, key=lambda v: (-n[v], v)) for w, b in beside.items() if b}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    root = {}
    for w in n:
        root[w] = w
        while root[w] in form:
            root[w] = form[root[w]]
    return sorted((w, form.get(w), root[w], n[w], len(beside[w]), n[form[w]] if w in form else None) for w in n)


@pytest.mark.parametrize("letters", ["ab", "abcÀé×", "aB"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(letters)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(150)], k=60)) + rng.choice((".", "", "1a"))) for i in range(80)]
    rows += [rows[3], (None, rows[4][1]), (1001, None), (1002, ""), (1003, "12 - 34"), (1004, "x" * 3_000 + " " + "x" * 1_499 + "y" + "x" * 1_500), (1005, "x" * 3_000), (1006, "x" * 3_000)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = brute(rows)
    assert len(want) > 20 and any(r[1] for r in want)
    for coalesce in ("true", "false"):  # false: many short sort ranges
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        try:
            got = sorted(tuple(r) for r in spelling.variants(docs).collect())
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == want


def test_nodes_are_those_of_the_trie(spark):
    """Two keys have one number at a depth exactly if they begin alike, also across sort ranges; beginnings of one key alone have none."""
    rng = random.Random(8)
    keys = sorted({"".join(rng.choice("abü") for _ in range(rng.randint(1, 12))) for _ in range(400)} | {"a" * k for k in (1, 5, 40, 200)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.key: r.nodes for r in spelling.number_nodes(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got) == keys
    passed = Counter(k[:d] for k in keys for d in range(len(k) + 1))
    number = {}
    for k in keys:
        assert len(got[k]) == max(d for d in range(len(k) + 1) if passed[k[:d]] > 1) + 1
        for d, node in enumerate(got[k]):
            assert number.setdefault(k[:d], node) == node
    assert len(set(number.values())) == len(number)


def test_long_words_in_linear_work(spark):
    """Two runs of 200,000 letters that differ in one."""
    a = "ab" * 100_000
    b = a[:77_777] + "q" + a[77_778:]
    words = spark.createDataFrame([(0, a), (1, b), (2, a[:-1])], "id long, word string")
    assert sorted(tuple(r) for r in spelling.near_words(words).collect()) == [(0, 2, 1), (1, 1, 0), (2, 1, 0)]


def test_no_rows_and_no_words(spark, nothing, docs):
    assert spelling.variants(nothing).count() == 0
    assert spelling.variants(docs.where("text IS NULL OR text = ''")).count() == 0
    assert spelling.variants(docs).where(F.col("n") < 3).count() == 0
