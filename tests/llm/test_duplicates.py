"""Near duplicates and repeated windows against brute force."""

import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import components, minhash, recompress, storage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows, per_cent):
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_components_equal_brute_force(docs):
    for per_cent, rows in ((85, 6), (80, 5)):
        want = brute_components([x for x in pairs(docs) if x[0] is not None], per_cent)
        got = minhash.near_duplicates(docs, per_cent=per_cent, rows=rows).collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)
        assert any(r.component_id != r.doc_id for r in got)


def test_a_sketch_with_few_bands_still_links_what_shares_a_bucket(docs):
    """Every bucket left in several components goes through the exact rest."""
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, per_cent=85, rows=1, bands=24).collect() if r.doc_id is not None}
    want = brute_components([x for x in pairs(docs) if x[0] is not None], 85)
    assert got == {d: c for d, (_, c) in want.items()}


def test_near_duplicates_of_nothing(nothing):
    out = minhash.near_duplicates(nothing)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (140, 100), (200, 201), (201, 200)]
    got = {r.v: r.m for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 141)} | {201: 200}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_windows(rows, width):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        if doc_id in out:
            continue
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out[doc_id] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_removed_windows_equal_brute_force(docs):
    rows = [(d, t or "") for d, t in pairs(docs) if d is not None]
    for width in (20, 7):
        want = brute_windows(rows, width)
        got = recompress.remove_repeats(docs, width=width).collect()
        assert len(got) == docs.count()
        for r in got:
            if r.doc_id is None:
                assert r.n_removed == 0
            else:
                assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
        assert sum(r.n_removed for r in got) > 100


def test_no_windows_in_nothing(nothing):
    assert recompress.remove_repeats(nothing).count() == 0


def test_only_windows_that_stand_alone_are_ruled_out():
    """The rounds on one slice against a count of all windows."""
    left_alone = total = 0
    for seed in range(120):
        rng = random.Random(seed)
        width, base = rng.choice((5, 8, 20)), [rng.randint(1, rng.choice((2, 4, 50))) for _ in range(60)]
        docs = []
        for _ in range(6):
            w = []
            while len(w) < rng.randint(0, 120):
                i = rng.randrange(60)
                w += base[i : i + rng.randint(1, 50)] + [rng.randint(1, 60)] * rng.choice((0, 1, 1, 7))
            docs.append(w)
        name, n = np.array([x for w in docs for x in w], np.uint64), np.array([len(w) for w in docs])
        s = recompress.Symbols.of_slice(name, np.arange(len(name)), n, width, [])
        starts = s.at
        for r in range(recompress.ROUNDS + 1):
            s.propose(r)
            s.replace(np.flatnonzero(s.multi))
        count = Counter(tuple(name[p : p + width]) for p in starts)
        kept = set(s.at.tolist())
        assert all(p in kept for p in starts.tolist() if count[tuple(name[p : p + width])] > 1)
        total += len(starts)
        left_alone += sum(count[tuple(name[p : p + width])] == 1 for p in kept)
    assert left_alone < total / 2


def test_words_are_told_apart_by_their_bytes(monkeypatch):
    from hearthline.llm.words import word_spans

    data = np.frombuffer(b"one two one ab two", np.uint8)
    begins, ends, _ = word_spans(data, np.array([0, len(data)]))
    honest = recompress.distinct_words(data, begins, ends)
    monkeypatch.setattr(recompress, "word_hashes", lambda d, b, e: np.ones(len(b), np.uint64))
    clash = recompress.distinct_words(data, begins, ends)
    for local, first in (honest, clash):
        words = [data[begins[f] : ends[f]].tobytes() for f in first]
        assert [words[i] for i in local] == [b"one", b"two", b"one", b"ab", b"two"]


def test_a_slice_takes_few_megabytes_of_a_task(monkeypatch):
    """Memory of the parser and of the first two rounds, and their largest rows, over a batch of 9 MB of text."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(60_000)]
    batch = pa.record_batch([pa.array(range(400)), pa.array([" ".join(rng.choices(vocabulary, k=3_500)) for _ in range(400)])], names=["id", "text"])
    monkeypatch.setattr(recompress.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))

    def largest(rows):
        most, out = 0, []
        tracemalloc.start()
        for row in rows:
            most = max(most, row.nbytes)
            out.append(row)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6, peak / 1e6, out

    row_mb, peak_mb, parsed = largest(recompress._parse(20)(iter([batch])))
    assert row_mb < 3 and peak_mb < 75
    assert sum(len(x.column("n")[0]) for x in parsed) == 400
    state = parsed
    for r in range(2):
        made = [pa.array([np.arange(len(x.column("made")[0]), dtype=np.int64)], pa.list_(pa.int64())) for x in state]
        given = [x.append_column("given", g) for x, g in zip(state, made)]
        if not r:
            given = [x.append_column("copies", pa.array([[]], pa.list_(pa.int64()))) for x in given]
        row_mb, peak_mb, state = largest(recompress._round(r, 20)(iter(given)))
        assert row_mb < 3 and peak_mb < 75


def test_names_of_a_slice_are_read_back_as_packed():
    rng = np.random.default_rng(3)
    for size in (0, 1, 700):
        table = rng.integers(0, 1 << 64, max(size // 3, size and 1), np.uint64)
        local = rng.integers(0, max(len(table), 1), size)
        packed = dict(zip(("table", "local"), recompress._pack_names(table, local)))
        names, places = recompress._unpack_names(packed)
        assert (names[places] == table[local]).all() and len(places) == size
        rising = np.cumsum(rng.integers(0, 9, size))
        assert (recompress._unpack(recompress._pack(rising)) == rising).all()


def test_tables_in_the_shared_folder_can_be_swept(spark):
    kept = storage.materialise(spark.range(3))
    storage.sweep(spark)
    with pytest.raises(Exception):
        kept.count()
