"""WARC bundles, mixing and licence scans: round trips, and the rows of their SQL."""

import hashlib
import math

import duckdb
import pandas as pd
import zstandard

import pytest

from hearthline.llm import licences, mixing, warc


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.sql(sql).df()


def same_rows(got, want):
    def clean(v):
        return None if pd.isna(v) else round(float(v), 9) if not isinstance(v, str) else v

    rows = lambda f: sorted((list(map(clean, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False)), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


PAGES = [(9 - i, f"http://e.org/{i}", h) for i, h in enumerate(["<p>é</p>" * 40, "<p>é</p>" * 40, "short", "short", None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100])] + [
    (50, None, "z\r\n\r\nz" * 50), (51, "http://a\r\nb", "big " * 200_000), (None, None, "y" * 100), (3, "again", "<p>w</p>" * 30), (3, "again", "<p>w</p>" * 30),
]


def test_bundles_round_trip(spark):
    pages = spark.createDataFrame([(*p, "d", "t", 1) for p in PAGES], "page_id long, url string, html string, digest string, payload string, first int").repartition(2)
    bundles = warc.write_bundles(pages, frame_size=2000, bundle_size=20_000)
    got = warc.read_bundles(bundles).collect()
    assert len(got) == len(PAGES)
    full = {}
    for i, _, h in PAGES:
        full.setdefault((h or "").encode(), []).append(i)
    by_id = {}
    for i, _, h in PAGES:
        by_id.setdefault(i, set()).add((h or "").encode())
    for r in got:
        payload = next(p for p in by_id[r.page_id] if hashlib.sha256(p).hexdigest() == r.payload_digest)
        assert r.payload_bytes == len(payload)
        first = min(i for i in full[payload] if i is not None)
        revisit = len(payload) >= 100 and r.page_id != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert r.payload == (None if revisit else payload)
    assert {r.url for r in got if r.page_id == 51} == {"http://a b"}


def test_frames_are_independent_and_the_whole_is_plain_zstandard(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    bundle = warc.write_bundles(pages, frame_size=1000, bundle_size=10**9).collect()[0]
    content = bytes(bundle.content)
    table = warc.seek_table(content)
    frames = [warc.frame_bytes(content, table, i) for i in range(len(table))]
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole == b"".join(frames) and len(table) > 3
    for r in bundle.records:
        fields, _, _ = warc.parse(frames[r.frame][r.offset : r.offset + r.length])
        assert fields["WARC-Record-ID"] == f"<urn:page:{'' if r.page_id is None else r.page_id}>"


def test_bundles_of_nothing_and_export(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0
    bundles = warc.write_bundles(pages)
    warc.export(bundles, f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").iterdir())) == bundles.count()


def test_mix_equals_its_sql(docs, nothing):
    got = mixing.mix(docs)
    want = sql_rows(mixing.ORACLE, documents=docs.select("doc_id", "text", "source").toArrow())
    same_rows(got.toPandas(), want)
    assert mixing.mix(nothing).count() == 0


def test_mix_comes_near_its_targets_and_repeats(spark):
    import random

    rng = random.Random(1)
    rows = [(i, "w " * int(rng.paretovariate(1.1) * 20), f"s{min(i % 11, i % 7, 4)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and math.isclose(got.groupby("source").target.first().sum(), 1.5 * got["size"].sum())
    sums = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), longest=("size", "max"))
    assert ((sums.taken - sums.target).abs() <= 0.02 * sums.target + sums.longest / 4).all()
    again = mixing.mix(docs.repartition(7, "text")).toPandas()
    assert got.sort_values("doc_id").copies.tolist() == again.sort_values("doc_id").copies.tolist()
    out = mixing.repeat(docs.withColumnRenamed("source", "source")).groupBy("doc_id").count().toPandas()
    assert dict(zip(out.doc_id, out["count"])) == {i: c for i, c in zip(got.doc_id, got.copies) if c}


def test_a_share_beyond_every_cap_fills_all(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "", "y"), (3, None, None)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(docs, share=9.0).collect()}
    assert got[1].taken == 6 and got[2].target == got[3].target == 0


LINES = [
    "Licensed under the Apache License, Version 2.0.", "licensed UNDER the apache license version 2.0", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "This is licensed under the Apache License, Version 2.0", "We released the version under a tree.", "", "license license license " * 3000, "MIT",
    "Redistribution and use in source and binary forms,\nwith or without modification, are permitted provided\nthat the following conditions are met:",
]


def test_licences_equal_their_sql(spark, docs, nothing):
    rows = [(i, f"Foo bar.\n{x}\n\nBaz {i}\n \n{x}") for i, x in enumerate(LINES)] + [(i + 100, x) for i, x in enumerate(LINES)] + [(7, None), (None, LINES[0])]
    known = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (known, docs.select("doc_id", "text")):
        same_rows(licences.scan(table).toPandas(), sql_rows(licences.oracle(), documents=table.toPandas()))
    assert {r.licence for r in licences.scan(known).where("doc_id = 103").collect()} == {"GPL-3.0"}
    assert licences.scan(known).where("part = 'block' AND licence = 'BSD grant'").count() > 0
    assert licences.scan(nothing).count() == 0 and licences.scan(docs.withColumn("part", docs.size)).count() == 0

def test_licences_repeated_embedded_and_wrapped(spark):
    t = licences.TEMPLATES
    fill = " ".join(f"w{i}" for i in range(60))
    w = t["Apache-2.0 header"].split()
    wrapped = "/* Copyright 2020 J. Doe\n" + "".join(f" * {' '.join(w[i : i + 7])}\n" for i in range(0, len(w), 7)) + " */\n" + "".join(f"int x{i} = f(y{i}, z{i});\n" for i in range(30))
    texts = [t["MIT grant"] + " " + t["MIT grant"], f"{fill} {t['GPL-3.0']} {fill}", wrapped, f"{fill} {t['MIT']} {fill}\n{t['BSD-3-Clause']}", t["GPL-3.0"] + "\n" + t["GPL-3.0"], fill + " licensed under the licence", "x"]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[1])], "doc_id long, text string")
    got = sorted(((r.doc_id, r.part, r.place, r.licence) for r in licences.scan(df, windows=True).where("part = 'window' OR doc_id = 0").collect()), key=str)
    assert got == sorted([(0, "line", 1, "MIT grant"), (1, "window", 61, "GPL-3.0"), (2, "window", 5, "Apache-2.0 header"), (3, "window", 61, "MIT"), (None, "window", 61, "GPL-3.0")], key=str)
    plain = lambda r: (r.doc_id, r.part, r.place, r.licence, r.dice)
    assert {plain(r) for r in licences.scan(df).collect()} == {plain(r) for r in licences.scan(df, windows=True).where("part <> 'window'").collect()}



def test_bodies_of_licence_files(spark):
    """Whole licence files with titles, other holders, wrapped lines and bullets for numbers; one has a clause more than the other."""
    def file(name, title, gap):
        w = licences.TEMPLATES[f"{name} text"].replace(" 1. ", " * ").replace(" 2. ", " * ").replace("COPYRIGHT HOLDER ", "REGENTS ").split()
        return f"{title}\n\nCopyright (c) 2019-2024 Zoë Müller and others <z@example.org>\n{gap}" + "\n".join(" ".join(w[i : i + 11]) for i in range(0, len(w), 11)) + "\n\nint main() { return 0; }\n"

    names = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"]
    texts = [file(n, n + " licence", "\n") for n in names] + [file(n, "Licence", "") for n in names] + [" ".join(licences.TEMPLATES["MIT text"].split()[90:])]
    found = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), windows=True).where("licence LIKE '% text'").collect()
    assert {(r.doc_id, r.licence) for r in found} == {(i, f"{names[i % 4]} text") for i in range(8)}
    for r in found:
        grams = lambda t: set(licences._bigrams(licences._words(t)))
        if r.part == "window":
            size = len(licences._words(licences.TEMPLATES[r.licence]))
            a, b = grams(licences.TEMPLATES[r.licence]), grams(" ".join(licences._words(texts[r.doc_id])[r.place - 1 : r.place - 1 + size]))
            assert r.dice == pytest.approx(2 * len(a & b) / (len(a) + len(b)))


def test_every_match_holds_a_needle():
    needles = licences.needles(licences.TEMPLATES)
    for text in licences.TEMPLATES.values():
        grams = licences._bigrams(licences._words(text))
        bare = [g for g in grams if not any(n in w if len(n) > 4 else n == w for n in needles for w in g.split())]
        assert len(bare) < -(-licences.TENTHS * len(grams) // (20 - licences.TENTHS))
