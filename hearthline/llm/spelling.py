"""Spelling variants: words one edit apart, by pairs of trie nodes, and the frequent form that each rare word stands for.

The distinct words are sorted, once as they are and once reversed, and the nodes of both tries are numbered along the sort. A word without its i-th letter is
the pair (node of the i letters before, node of the reversed letters after): words with the same pair differ in that letter alone. A word cut before its i-th letter is such
a pair too, and meets the words that have one letter more at that place. All words of one pair are near each other, and there are at most as many as letters,
so a pair's group is small whatever the text. Nodes that only one word passes can't be shared, and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.storage import discard, materialise, spread_key

#: Fixed value: the letters of which runs are made.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every so manieth run, by its checksum, loses a letter.
EVERY = 97


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (word) per run of letters: A-Z lower-cased; of the runs whose crc32 of "id:run" EVERY divides, one letter is taken out. A run of a row without an id keeps its letters."""
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("w"))
    ascii_only = F.octet_length("w") == F.char_length("w")
    found = found.select("id", F.when(ascii_only, F.lower("w")).otherwise(F.translate("w", UPPER, LOWER)).alias("w"))
    h = F.crc32(F.concat("id", F.lit(":"), F.col("w")).cast("binary"))
    found = found.select("w", h.alias("h"))
    at = (F.col("h") % F.char_length("w")).cast("int")
    less = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
    return found.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("w")).alias("word"))


def _shared(a: str, b: str) -> int:
    """How many letters two words begin with alike."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    if n > 64:
        return len(commonprefix((a, b)))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def number_nodes(keys: DataFrame) -> DataFrame:
    """(key, nodes) from distinct keys: the numbers of the trie nodes of the key's beginnings, from the root (0) to the last that another key shares.

    Keys are sorted by ranges. A node that two ranges share is a beginning of what the last key of one and the first key of the next begin with alike; the driver
    numbers these from the first and last key of each range (below 0); all other nodes are numbered inside their range.
    """
    ordered = materialise(keys.repartitionByRange("key").select("key", F.spark_partition_id().cast("long").alias("part")))
    ends = ordered.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part").collect()  # one row per range
    crossing: list[list[int]] = []  # by border: the numbers of its nodes, outermost first
    new, before = -1, ""
    for x, y in zip(ends, ends[1:]):
        border = y["first"][: _shared(x["last"], y["first"])]
        kept = _shared(before, border)
        fresh = list(range(new, new - (len(border) - kept), -1))
        new -= len(fresh)
        crossing.append((crossing[-1][:kept] if crossing else []) + fresh)
        before = border
    borders = {x["part"]: (x["first"], crossing[k - 1] if k else [], x["last"], crossing[k] if k < len(crossing) else []) for k, x in enumerate(ends)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, path, held, out = None, 0, [], None, ([], [])

        def put(key: str, alike: int, after: int) -> None:
            """key follows a key of the same range with which it begins alike in so many letters; with the next key, in ``after``."""
            nonlocal count
            first, left, last, right = borders[part]
            depth = max(alike, after)
            del path[alike:]
            if depth > alike:
                from_left, from_right = min(len(left), _shared(key, first)), min(len(right), _shared(key, last))
                for d in range(alike, depth):
                    if d < from_left:
                        path.append(left[d])
                    elif d < from_right:
                        path.append(right[d])
                    else:
                        count += 1
                        path.append(part << 40 | count)
            out[0].append(key)
            out[1].append([0, *path])

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int64()))], names=["key", "nodes"])
            out[0].clear(), out[1].clear()
            return made

        for batch in batches:
            for key, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is not None:
                    same = of == part
                    alike = _shared(held[0], key) if same else 0
                    put(held[0], held[1], alike if same else len(borders[part][3]))
                if of != part:
                    part, count, path = of, 0, []
                    # what the first key shares with the range before is numbered already
                    path.extend(borders[of][1])
                    held = (key, len(path))
                else:
                    held = (key, alike)
            if len(out[0]) >= 5_000:
                yield batch_out()
        if held is not None:
            put(held[0], held[1], len(borders[part][3]))
        yield batch_out()

    return ordered.repartition("part").sortWithinPartitions("part", "key").select("key", "part").mapInArrow(run, "key string, nodes array<long>")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best) from words (id, word): how many words are one edit away, and the smallest id among these. Words without any are left out."""
    ahead = number_nodes(words.select(F.col("word").alias("key"))).withColumnsRenamed({"key": "word", "nodes": "ahead"})
    back = number_nodes(words.select(F.reverse("word").alias("key"))).select(F.reverse("key").alias("word"), F.col("nodes").alias("back"))
    both = words.join(ahead, "word").join(back, "word").withColumn("size", F.char_length("word"))
    # places where the letters before and those after are both shared with another word; letters of a run of one letter are one deletion
    skips = F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: (i < F.size("ahead")) & (F.col("size") - 1 - i < F.size("back")))
    cuts = F.filter(F.sequence(F.lit(0), F.col("size")), lambda i: (i < F.size("ahead")) & (F.col("size") - i < F.size("back")))
    letters = F.split("word", "")
    again = lambda i: (i > 0) & (F.get("letters", i) == F.get("letters", i - 1))
    skipped = F.transform("skips", lambda i: F.struct(F.get("ahead", i).alias("p"), F.get("back", F.col("size") - 1 - i).alias("s"), (F.col("id") * 4 + F.when(again(i), 2).otherwise(1)).alias("m")))
    cut = F.transform("cuts", lambda i: F.struct(F.get("ahead", i).alias("p"), F.get("back", F.col("size") - i).alias("s"), (F.col("id") * 4).alias("m")))
    pairs = both.select("id", "ahead", "back", "size", letters.alias("letters"), skips.alias("skips"), cuts.alias("cuts")).select(F.inline(F.concat(skipped, cut)))
    grouped = pairs.repartition("p", "s").groupBy("p", "s").agg(F.sort_array(F.collect_list("m")).alias("m")).where(F.size("m") > 1)
    of = lambda x: F.floor(x / 4).cast("long")
    kind = lambda x: x % 4
    grouped = grouped.select("m", F.filter("m", lambda x: kind(x) > 0).alias("skip"), F.filter("m", lambda x: kind(x) == 1).alias("once"), F.filter("m", lambda x: kind(x) == 0).alias("cut"))
    other = lambda x: F.when(F.get("skip", F.lit(0)) == x, F.get("skip", F.lit(1))).otherwise(F.get("skip", F.lit(0)))
    member = lambda x: F.struct(
        of(x).alias("id"),
        F.when(kind(x) == 0, F.size("once")).otherwise(F.size("skip") - 1 + F.when(kind(x) == 1, F.size("cut")).otherwise(0)).alias("n"),
        of(F.when(kind(x) == 0, F.get("once", F.lit(0))).otherwise(F.least(other(x), F.when(kind(x) == 1, F.get("cut", F.lit(0)))))).alias("best"),
    )
    met = grouped.select(F.inline(F.transform("m", member))).where("n > 0")
    return met.groupBy(spread_key("id"), "id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best")).select("id", "n_near", "best")


def _ends(forms: DataFrame) -> DataFrame:
    """(id, end) from (id, to): the last of the chain that begins at id. Chains never turn back; every round doubles the steps taken."""
    now = materialise(forms.select("id", F.col("to").alias("end")))
    while True:
        on = now.select(F.col("id").alias("end"), F.col("end").alias("further"))
        both = materialise(now.join(on, "end", "left").select("id", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")), drop=now)
        now = both
        if not both.where("moved").limit(1).count():
            return both


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, shortest: int = 5, times: int = 2) -> DataFrame:
    """Per word of the runs of docs (at least ``shortest`` letters, ``least`` occurrences): word, form, root, n, n_near, form_n.

    form is the near word (one letter put in, taken out or replaced) of largest n, ties going to the smallest in code-point order, if its n is at least ``times`` the word's, else
    null; root is the last of the forms of forms. Rows that repeat count as often as they stand; null and empty texts have no runs; no documents give no rows; other columns of docs are not read.
    Texts and runs may be of any length: work and memory grow with a run's length, not with its square. A word that very many share is summed in every task first.
    """
    counted = runs(docs, id_col, text_col).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.char_length("word") >= shortest))
    # ids in order of n from the largest, then of the word: the smallest id of several is the form
    words = materialise(counted.orderBy(F.col("n").desc(), "word").withColumn("id", F.monotonically_increasing_id()))
    near = materialise(near_words(words.select("id", "word")))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    joined = words.join(near, "id", "left")
    chosen = joined.where("best IS NOT NULL").join(best, "best").where(F.col("form_n") >= times * F.col("n"))
    forms = materialise(chosen.select("id", F.col("best").alias("to"), "form", "form_n"))
    ends = _ends(forms)
    rooted = ends.select("id", F.col("end").alias("best")).join(best.select("best", F.col("form").alias("root")), "best").select("id", "root")
    out = joined.join(forms.drop("to"), "id", "left").join(rooted, "id", "left")
    out = materialise(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
    for table in (words, near, forms, ends):
        discard(table)
    return out


#: DuckDB: the rows of variants() with its defaults.
ORACLE = r"""
WITH t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), g AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY doc_id, w), b AS (
  SELECT w, n, list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''),
           lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))) AS bytes FROM g
), h AS (
  SELECT w, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t
), m AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h
), c AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5), k AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word)))::INT AS i FROM c)
), e AS MATERIALIZED (
  SELECT x.word AS a, y.word AS b FROM k x JOIN k y ON x.i = y.i AND x.p = y.p AND x.s = y.s AND x.word <> y.word
  UNION SELECT k.word, c.word FROM k JOIN c ON c.word = k.p || k.s
  UNION SELECT c.word, k.word FROM k JOIN c ON c.word = k.p || k.s
), f AS MATERIALIZED (
  SELECT a, count(*) AS n_near, arg_min(b, (-y.n, b)) AS form, max(y.n) AS form_n FROM e JOIN c y ON y.word = b GROUP BY a
), v AS MATERIALIZED (
  SELECT c.word, c.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * c.n THEN form END AS form, CASE WHEN form_n >= 2 * c.n THEN form_n END AS form_n
  FROM c LEFT JOIN f ON f.a = c.word
), o AS (
  WITH RECURSIVE walk AS (SELECT word, word AS at FROM v UNION ALL SELECT walk.word, v.form FROM walk JOIN v ON v.word = walk.at WHERE v.form IS NOT NULL)
  SELECT walk.word, walk.at AS root FROM walk JOIN v ON v.word = walk.at WHERE v.form IS NULL
)
SELECT v.word, form, root, n, n_near, form_n FROM v JOIN o USING (word)
"""
