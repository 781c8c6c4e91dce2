"""License scans: lines and blocks of a text against licence templates by Dice over word bigrams, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, as usually written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
}
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
#: Bodies of licence files, from the grant to the end of the warranty, without title and holders.
TEMPLATES |= {
    "MIT text": TEMPLATES["MIT grant"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES "
    "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause text": f"{TEMPLATES['BSD grant']} 1. {_SOURCE}2. {_BINARY}{_WARRANTY}",
    "BSD-3-Clause text": f"{TEMPLATES['BSD grant']} 1. {_SOURCE}2. {_BINARY}3. {_NAMES}{_WARRANTY}",
}
#: Least Dice coefficient, in tenths.
TENTHS = 8


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def _bigrams(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))


def needles(templates: dict[str, str], tenths: int = TENTHS) -> list[str]:
    """Word beginnings of five or six letters (or whole short words) of which every text that reaches the coefficient with some template holds one.

    Such a text has at least tenths / (20 - tenths) of the template's b bigrams, so it has one of any b - that + 1 of them; needles
    are taken, those of use to most templates first and short words last, until each template has that many bigrams with a needle.
    """
    left = {}
    for name, text in templates.items():
        grams = _bigrams(_words(text))
        left[name] = [grams, len(grams) - -(-tenths * len(grams) // (20 - tenths)) + 1]
    has = lambda n, gram: any(n in w if len(n) > 4 else n == w for w in gram.split())
    offered = {w[:6] if len(w) > 4 else w for text in templates.values() for w in _words(text)}
    out: list[str] = []
    while any(need > 0 for _, need in left.values()):
        gain = {n: sum(min(need, sum(has(n, g) for g in grams)) for grams, need in left.values() if need > 0) for n in offered}
        n = max(offered, key=lambda n: (len(n) > 4 and gain[n] > 0, gain[n], len(n), n))
        out.append(n)
        offered.discard(n)
        for name, (grams, need) in left.items():
            rest = [g for g in grams if not has(n, g)]
            left[name] = [rest, need - (len(grams) - len(rest))]
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, tenths: int = TENTHS, id_col: str = "doc_id", text_col: str = "text", windows: bool = False) -> DataFrame:
    """id, part, place, licence and dice: each line, and each block of two or more lines between blank ones, whose
    bigram set has a Dice coefficient of tenths / 10 or more with a template; the best one (of equals the last by name).

    Text is lower-cased and all but letters and digits is space. A template is only compared if the sizes allow the coefficient:
    tenths * (a + b) <= 20 * min(a, b), a and b being numbers of distinct bigrams. Documents and parts without a word that some match must hold are passed over.
    Lines and blocks count from 1. Null and empty texts, and lines of fewer than two words, match nothing. Rows that
    repeat give rows that repeat; a null id is carried along.

    With ``windows`` also notices inside longer lines or over several ones (part 'window', place counts words from 1): runs of as many words as a template has, across
    lines, that begin with one of its bigrams and reach the coefficient. Of runs that overlap the one with most bigrams in common stays; runs whose
    common bigrams all stand in lines and blocks already found are left out.
    """
    templates = TEMPLATES if templates is None else templates
    columns = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, part string, place long, licence string, dice double"
    known = [{"name": n, "grams": g, "n": len(g), "words": len(_words(t))} for n, t in sorted(templates.items()) if (g := _bigrams(_words(t)))]
    if not known:
        return docs.sparkSession.createDataFrame([], columns)
    sizes = [t["n"] for t in known]
    least, most = -(-min(sizes) * tenths // (20 - tenths)), max(sizes) * (20 - tenths) // tenths
    table = F.array(*(F.struct(F.lit(t["name"]).alias("name"), F.array(*map(F.lit, t["grams"])).alias("grams"), F.lit(t["n"]).alias("n"), F.lit(t["words"]).alias("words"), F.lit(-(-tenths * t["n"] // (20 - tenths))).alias("need")) for t in known))

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # An array of one binds a value to a name, so that it is worked out once.
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    some = "|".join(n if len(n) > 4 else f"(?<![a-z0-9]){n}(?![a-z0-9])" for n in needles(templates, tenths)) or "(?!)"
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("part"), (i + 1).alias("place"), x.alias("s")))
    blocks = F.transform(F.split("text", r"\n[ \t\r]*\n"), lambda x, i: F.struct(F.lit("block").alias("part"), (i + 1).alias("place"), x.alias("s")))
    parts = F.filter(F.concat(lines, F.filter(blocks, lambda x: F.trim(x["s"]).contains("\n"))), lambda x: F.lower(x["s"]).rlike(some))
    words = lambda s: F.split(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), " ")
    follow = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    grams = lambda s: once(words(s), lambda w: F.when(F.size(w) > F.greatest(F.lit(1), F.lit(least)), F.array_distinct(follow(w))))

    def best(g: Column) -> Column:
        fits = F.filter(table, lambda t: tenths * (t["n"] + F.size(g)) <= 20 * F.least(t["n"], F.size(g)))
        return F.array_max(F.transform(fits, lambda t: F.struct((2.0 * F.size(F.array_intersect(t["grams"], g)) / (t["n"] + F.size(g))).alias("dice"), t["name"].alias("licence"))))

    rated = F.col("id"), "p.part", "p.place", "p.s", once(grams(F.col("p.s")), lambda g: F.when(F.size(g) <= most, best(g))).alias("best")
    if not windows:
        found = slim.where(F.lower("text").rlike(some)).select("id", F.explode(parts).alias("p")).select(*rated).where(10 * F.col("best.dice") >= tenths)
        return found.select(F.col("id").alias(id_col), "part", F.col("place").cast("long").alias("place"), F.col("best.licence").alias("licence"), F.col("best.dice").alias("dice"))

    rate = lambda p: F.struct(p["part"].alias("part"), p["place"].alias("place"), p["s"].alias("s"), once(grams(p["s"]), lambda g: F.when(F.size(g) <= most, best(g))).alias("best"))
    held = slim.where(F.lower("text").rlike(some)).withColumn("found", F.filter(F.transform(parts, rate), lambda p: 10 * p["best"]["dice"] >= tenths))
    held = held.withColumn("grams", once(words(F.col("text")), follow))
    # the bigrams, by place, that each part found takes up
    count = lambda s: F.size(F.filter(words(s), lambda w: w != ""))
    split = lambda p: F.when(p["part"] == "line", F.split("text", "\n")).otherwise(F.split("text", r"\n[ \t\r]*\n"))
    held = held.withColumn("spans", F.transform("found", lambda p: once(count(F.array_join(F.slice(split(p), 1, p["place"] - 1), " ")), lambda n: F.struct((n + 1).alias("a"), (n + count(p["s"]) - 1).alias("b")))))
    every = F.array(*map(F.lit, sorted({g for t in known for g in t["grams"]}) or [""]))
    held = held.withColumn("near", F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(every, g), i + 1)), lambda i: i.isNotNull()))

    def window(t: Column, hits: Column, p: Column, k: Column) -> Column:
        # the hits from p on, in order: no more of them than words are inside
        own, inside = F.array_distinct(F.slice("grams", p, t["words"] - 1)), F.filter(F.slice(hits, k + 1, t["words"] - 1), lambda q: q <= p + t["words"] - 2)
        return once(F.struct(own.alias("g"), F.size(F.array_intersect(t["grams"], own)).alias("same"), inside.alias("hits")), lambda x: F.struct(x["same"].alias("same"), (2.0 * x["same"] / (t["n"] + F.size(x["g"]))).alias("dice"), t["name"].alias("licence"), (-p).alias("from"), x["hits"].alias("hits")))

    def runs(t: Column, near: Column) -> Column:
        hits = F.filter(near, lambda p: F.array_contains(t["grams"], F.element_at("grams", p)))
        full = lambda h, p, k: F.coalesce(F.get(h, k + t["need"] - 1) <= p + t["words"] - 2, F.lit(False))
        return once(hits, lambda h: F.filter(F.transform(h, lambda p, k: F.when(full(h, p, k), window(t, h, p, k))), lambda x: 10 * x["dice"] >= tenths))

    new = lambda x, spans: F.exists(x["hits"], lambda q: ~F.exists(spans, lambda s: (q >= s["a"]) & (q <= s["b"])))
    held = held.withColumn("runs", once(F.col("near"), lambda near: F.flatten(F.transform(table, lambda t: runs(t, near)))))
    held = held.withColumn("runs", once(F.col("spans"), lambda spans: F.reverse(F.array_sort(F.filter("runs", lambda x: new(x, spans))))))
    meet = lambda x, y: (-x["from"] <= F.array_max(y["hits"])) & (-y["from"] <= F.array_max(x["hits"]))
    held = held.withColumn("runs", F.aggregate("runs", F.slice("runs", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda y: meet(x, y)), kept).otherwise(F.concat(kept, F.array(x)))))
    row = lambda part, place, x: F.struct(part.alias("part"), place.cast("long").alias("place"), x["licence"].alias("licence"), x["dice"].alias("dice"))
    rows = F.concat(F.transform("found", lambda p: row(p["part"], p["place"], p["best"])), F.transform("runs", lambda x: row(F.lit("window"), -x["from"], x)))
    return held.select(F.col("id").alias(id_col), F.explode(rows).alias("r")).select(id_col, "r.*")


def oracle() -> str:
    """DuckDB SQL for the rows of scan() with its defaults."""
    rows = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in sorted(TEMPLATES.items()))
    norm = r"string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, {norm.format('body')} AS w FROM (VALUES {rows}) v(name, body))),
l AS (SELECT doc_id, 'line' AS part, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents
      UNION ALL
      SELECT * FROM (SELECT doc_id, 'block' AS part, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS s,
                            generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1) AS place FROM documents) b WHERE contains(trim(s, ' '), chr(10))),
d AS (SELECT doc_id, part, place, {norm.format('s')} AS w FROM l), e AS (SELECT doc_id, part, place, {grams} AS g FROM d WHERE len(w) > 1),
m AS (SELECT doc_id, part, place, name AS licence, 2.0::DOUBLE * len(list_intersect(e.g, t.g)) / (len(e.g) + len(t.g)) AS dice
      FROM e JOIN t ON {TENTHS} * (len(e.g) + len(t.g)) <= 20 * least(len(e.g), len(t.g)))
SELECT doc_id, part, place::BIGINT AS place, licence, dice FROM m WHERE 10 * dice >= {TENTHS}
QUALIFY row_number() OVER (PARTITION BY doc_id, part, place ORDER BY dice DESC, licence DESC) = 1
"""
