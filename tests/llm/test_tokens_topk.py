"""Token counts against the tokenizer library, top-k against brute force."""

import math

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthline.llm import tokens, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER, LIBRARY = tokens.Counter(PATH), Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n a", "it's they'LL 12²Ⅳ x　z", " <|endoftext|> x<|endoftext|><|endoftext|>", "a\n \nb", "é😀 ٣٤", "x" * 3000, "ab" * 2000, " " * 300 + "x", "'s 's'S", "a  b", "\x1c\x1d x"]


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert COUNTER.count(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abt hTe'\n\t  .,!12é<|>endoftx"), max_size=60))
def test_any_text(text):
    assert COUNTER.count(text) == library(text)


def test_counts_of_documents(docs, nothing):
    got = tokens.token_counts(docs, PATH, limit=50).collect()
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_tokens) == (len(want[r.doc_id].encode()), library(want[r.doc_id]))
            assert r.over_limit == (r.n_tokens > 50)
    assert tokens.token_counts(nothing, PATH).count() == 0


def test_top_k_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, 1.0)) * rng.random() for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # one vector many times: ties
    odd = [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, []), (905, [0.0] * 8), (None, [1.0] * 8), (906, [0.5, 0.25])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("score", F.lit("s"))
    asks = F.col("vec_id") % 50 == 0
    got = {}
    for r in topk.top_k(df, asks, k=10, block_rows=60, block_queries=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    sound = {i: [math.floor(1024 * x) for x in v] for i, v in rows + odd if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in sound if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q)[:10]
        assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert not got
    assert topk.top_k(df.limit(0), asks).count() == 0
    again = sorted(tuple(r) for r in topk.top_k(df.union(df.where("vec_id = 50")), asks, k=10, block_rows=60, block_queries=3).where("query_id = 50").collect())
    own = sum(x * x for x in sound[50])
    want = sorted([(-sum(a * b for a, b in zip(sound[50], v)), i) for i, v in sound.items() if i != 50] + [(-own, 50)])[:10]
    assert again == sorted(2 * [(50, n + 1, i, -s) for n, (s, i) in enumerate(want)])
    few = topk.top_k(df.where("vec_id IN (0, 1, 2)"), asks, k=10).collect()
    assert [r.rank for r in sorted(few)] == [1, 2]
