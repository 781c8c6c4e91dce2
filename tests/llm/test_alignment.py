"""Alignment of two tokenizers against its definition, and postings that round trip."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from hearthline.llm import alignment

from .conftest import words

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


def brute(aligner, texts):
    """The rows, straight from the definition."""
    each, held = [], Counter()
    for t in texts:
        groups, links = [], Counter()
        if t:
            a, b = aligner.a.encode(" " + t, add_special_tokens=False).ids, aligner.b.encode(t)
            whole = (" " + t).encode()
            if b"".join(aligner.a_bytes[i] for i in a) == whole == b"".join(aligner.b_bytes[i] for i in b):
                ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
                ea, eb = ends(a, aligner.a_bytes), ends(b, aligner.b_bytes)
                i = j = 0
                for end in sorted(set(ea) & set(eb)):
                    x, y = ea.index(end) + 1, eb.index(end) + 1
                    groups.append((a[i:x], b[j:y]))
                    links.update((p, q) for p in a[i:x] for q in b[j:y])
                    i, j = x, y
            else:
                a = b = ()
        else:
            a = b = ()
        each.append((len(a), len(b), groups, links))
        held.update(links.keys())
    top = Counter()
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    out = []
    for n_a, n_b, groups, links in each:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for (p, q), n in links.items() if held[p, q] == top[p])
        out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * held[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


ODD = [
    None, "", " ", "  two  spaces ", "a\n b\tc", "end ", "<|endoftext|> and </s> <unk> <0x41>", "▁lower bar", "x▁y", "日本語の文 \U0001f600\U0001f600 café", "a" * 3000,
    " " * 700 + "z", "́" * 50, "null\x00byte", "\x85  wide", "tab\x1c sep", "word " * 2000 + "end", "é" * 4000, "A B  C",
]


def test_alignment_equals_its_definition(spark, aligner):
    rng = random.Random(3)
    texts = [*ODD, *(" ".join(words(rng, rng.randint(1, 120))) for _ in range(60)), "The Transformer's attention, re-tokenised: 1234567 times!", "ababab" * 900]
    rows = [(i, t, "b", 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], "b", 1, 2), (None, "lost row", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, pair int, n_best int").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(docs, A, B).collect()), key=repr)
    want = sorted([(r[0], *x) for r, x in zip(rows, brute(aligner, [r[1] for r in rows]))], key=repr)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 60 and any(r[1] == 0 and r[0] == 7 for r in got)


def test_small_blocks_and_large_groups_change_nothing(aligner, monkeypatch):
    rng = random.Random(4)
    texts = ["aaaaaaaab" * 40, "éè" * 300, *(" ".join(words(rng, 30)) for _ in range(10))]
    before = alignment.align_block(aligner, texts)
    monkeypatch.setattr(alignment, "LARGE", 1)
    after = alignment.align_block(aligner, texts)
    assert before[0] == after[0] and all((x == y).all() for x, y in zip(before[1], after[1]))
    for t, (*_, n_links, _) in zip(texts, before[0]):
        one = alignment.align_block(aligner, [t])
        assert one[0][0][3] == n_links == one[1][2].sum()


@pytest.mark.parametrize("docs", [1, 9, 300, 1 << 15])
def test_postings_round_trip(docs):
    rng = np.random.default_rng(docs)
    rows = {(int(p), int(d)): int(t) for p, d, t in zip(rng.zipf(1.5, 3000).clip(1, 50), rng.integers(0, docs, 3000), rng.zipf(1.3, 3000).clip(1, 10**9))}
    keys = sorted(rows)
    pair, doc, times = np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([rows[k] for k in keys])
    pairs, dense, bits, planes = alignment.pack_postings(pair, doc, times, docs)
    row, back, n = alignment.unpack_postings(dense, bits, planes)
    assert {(int(pairs[r]), int(d)): int(t) for r, d, t in zip(row, back, n)} == rows
    row, back, n = alignment.unpack_postings(dense[3:], bits[3:], planes[3:])
    assert {(int(pairs[r + 3]), int(d)): int(t) for r, d, t in zip(row, back, n)} == {k: t for k, t in rows.items() if k[0] in pairs[3:]}


def test_alignment_of_no_rows(nothing):
    assert alignment.align(nothing, A, B).count() == 0
