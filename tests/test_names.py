"""Names in texts, longest first, and old names of wards, against brute force; dates in several patterns; levels that a query has to reach."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hearthline.functions import text
from hearthline.operators import market
from hearthline.sources import html


def test_longest_names_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["tay", "ho", "dong", "da", "x"]
    names = ["Tây Hồ", "hồ", "Hồ Đống", "Đống Đa", "da x tay", "tay ho dong da", "?", None, "tay"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(60)] + [(60, None), (61, ""), (62, "TÂY-HỒ, đống!đa"), (62, "tay ho")]
    texts = spark.createDataFrame(rows, "row_id long, t string")
    got = sorted((r.row_id, r.name, r.start, r.words) for r in market.name_spans(texts, spark.createDataFrame([(n,) for n in names], "n string"), "row_id", "t", "n").collect())
    plain = {tuple(w.split()): n for w, n in (("tay ho", "Tây Hồ"), ("ho", "hồ"), ("ho dong", "Hồ Đống"), ("dong da", "Đống Đa"), ("da x tay", "da x tay"), ("tay ho dong da", "tay ho dong da"), ("tay", "tay"))}
    want = []
    for i, t in rows:
        if i == 62:
            t = {"TÂY-HỒ, đống!đa": "tay ho dong da"}.get(t, t)
        w = (t or "").split()
        hits = [(s, n, name) for s in range(len(w)) for p, name in plain.items() for n in [len(p)] if tuple(w[s : s + n]) == p]
        want += [(i, name, s + 1, n) for s, n, name in hits if not any(m > n and r <= s and r + m >= s + n for r, m, _ in hits)]
    # the two texts of row 62 are one row's texts: places of one count for the other
    assert [r for r in got if r[0] != 62] == sorted(r for r in want if r[0] != 62) and (62, "tay ho dong da", 1, 4) in got


def test_renamed_wards_equal_brute_force(spark):
    rows = [("Phường Mỹ Đình 1", "A"), ("phường mỹ đình 2", "A"), ("Phường Láng 1", "B"), ("Láng 2", "C"), ("Cầu Giấy", "D"), ("Cau Giay", "D"), ("Xuân 3", None), ("12", "E"), (None, "F"), ("Kim 7", "G"), ("Kim", "H"), ("Ô 9", "K")]
    got = [(r.key, r.new, r.variants) for r in market.renamed_wards(spark.createDataFrame(rows, "o string, n string"), "o", "n").collect()]
    assert {k: (n, v) for k, n, v in got} == {"my dinh 1": ("A", 1), "my dinh 2": ("A", 1), "my dinh": ("A", 2), "lang 1": ("B", 1), "lang 2": ("C", 1), "cau giay": ("D", 1), "kim 7": ("G", 1), "o 9": ("K", 1)}
    assert [len(k) for k, *_ in got] == sorted((len(k) for k, *_ in got), reverse=True)


def test_written_dates(spark):
    df = spark.createDataFrame([("31/12/2024",), (" 01/02/2023 ",), ("31/02/2024",), ("2024-05-06",), ("gestern",), (None,)], "t string")
    plain = [str(r[0]) for r in df.select(text.written_date(F.col("t"))).collect()]
    both = [str(r[0]) for r in df.select(text.written_date(F.col("t"), "dd/MM/yyyy", "yyyy-MM-dd")).collect()]
    assert plain == ["2024-12-31", "2023-02-01", "None", "None", "None", "None"] and both[3] == "2024-05-06"


@pytest.mark.parametrize("name,column,levels", [("assigned_places", "level", 10), ("place_audit", "level", 7), ("unambiguous_names", "kind", 3), ("renamed_wards", "key", 5), ("longest_names", "name", 3), ("price_bands", "band", 4), ("metrics_report", "level", 3)])
def test_queries_reach_what_they_are_to_prove(spark, name, column, levels):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").select(column).distinct().collect()
    assert len(rows) >= levels and (name != "assigned_places" or re.search("None", str(rows)))


@pytest.mark.parametrize("find", [market.names_in_texts, market.name_spans])
def test_runs_of_words_are_split_once_and_not_sent_to_the_driver(spark, find):
    texts = spark.createDataFrame([(i, f"{i} Phố Láng Hạ de la") for i in range(5)] + [(9, None), (10, "")], "row_id long, t string")
    names = spark.createDataFrame([("Láng Hạ",), ("de la",), ("la",)], "n string")
    few, many = (find(texts, names, "row_id", "t", "n", most_names=m) for m in (10, 0))
    rows = sorted(map(tuple, few.collect()))
    assert rows == sorted(map(tuple, many.collect())) and len(rows) == (10 if find is market.name_spans else 15)
    plan = market.names_in_texts(texts, names, "row_id", "t", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "rightHint=(strategy=broadcast)" in plan


def test_pages_are_read_once_and_alike(spark):
    item = '<div class="re__pr-short-info-item"><span class="title">{}</span> <span class="value">{}</span></div>'
    shown = [[("Mã tin", "1"), ("Loại tin", "a"), ("LOẠI TIN", "b"), ("Loại tin", "c")], [("Loại tin", "")], [("LOẠI TIN", "x"), ("Loại tin", "y"), ("LOẠI TIN", "z")]]
    pages = [(i, "".join(item.format(*p) for p in facts) + f"<script>{{productId: {i}, xprice: 4}}</script>") for i, facts in enumerate(shown)] + [(8, None), (9, "")]
    df = spark.createDataFrame(pages, "i long, html string").withColumn("url", F.lit("u"))
    got = html.listing_pages(df, "html", "url", "i")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.select("i", *(c.alias(n) for n, c in html.listing_page(F.col("html"), F.col("url")).items())).collect()))
    assert {r.i: (r.listing_id, r.tier, r.price) for r in got.collect()} == {0: ("1", "b", None), 1: ("1", "", None), 2: ("2", "y", None), 8: (None, None, None), 9: (None, None, None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("re__pr-short-info-item") == 2
