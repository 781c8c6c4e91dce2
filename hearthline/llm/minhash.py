"""Near duplicates by word shingles: fast similarity sketches, banding, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.components import components
from hearthline.llm.sketch import band_keys, sketches
from hearthline.llm.storage import discard, materialise, spread_key
from hearthline.llm.words import LOWER, M3, U, mix, shingle_hashes, slices, word_hashes, word_spans


def shingle_sets(batch: pa.RecordBatch, text: str, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b) of the batch with their distinct shingles, sorted, and the row of each. Fewer than ``width`` words: one shingle of them all; no words: none."""
    for a, b, data, offsets in slices(batch, text):
        data = LOWER[data]
        starts, ends, bounds = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        shingles, row = shingle_hashes(words, bounds, width)
        counts = np.diff(bounds)
        if len(short := np.flatnonzero((counts > 0) & (counts < width))):
            with np.errstate(over="ignore"):
                whole = mix(counts[short].astype(np.uint64))
                for k in range(width - 1):
                    has = counts[short] > k
                    whole[has] = mix(whole[has] * M3 + words[bounds[short[has]] + k])
            shingles, row = np.concatenate([shingles, whole]), np.concatenate([row, short])
        order = np.lexsort((shingles, row))
        shingles, row = shingles[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (row[1:] != row[:-1])
        yield a, b, shingles[new], row[new]


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketcher(text: str, width: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shingles, row in shingle_sets(batch, text, width):
                n = np.bincount(row, minlength=b - a)
                bounds = np.concatenate([[0], np.cumsum(n)])
                with np.errstate(over="ignore"):
                    # a set's fingerprint: sums over its elements, whatever their order
                    sums = [np.concatenate([[U(0)], np.cumsum(mix(shingles ^ U(s)))]) for s in (0x5A, 0xC3)]
                    f1, f2 = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                keys = band_keys(sketches(shingles, row, b - a, rows * bands), rows)
                key_bounds = np.arange(b - a + 1) * bands
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), _lists(keys.ravel(), key_bounds)],
                    names=["id", "n", "f1", "f2", "bands"],
                )

    return run


def _set_maker(text: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, shingles, row in shingle_sets(batch, text, width):
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(shingles, bounds)], names=["rep", "set"])

    return run


def _ceil_div(x: Column, y: int) -> Column:
    return F.floor((x + (y - 1)) / y)


def _linked(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= per_cent * union."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("i") >= per_cent * (F.size("sa") + F.size("sb") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _rest_of_pairs(members: DataFrame, sets: DataFrame, edges: DataFrame, per_cent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Candidate pairs, and the tables that they are read from, from buckets that the links so far leave in two or more components.

    Members of such buckets get prefix filtering, exact for any two sets at the threshold: shingles are put in one order
    (those of one component only, then from rare to common), and sets that reach the threshold share one in
    their first few, at positions that leave enough to share.
    """
    label = components(edges)
    labelled = members.join(label.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("m", "rep").alias("comp"))
    mixed = labelled.groupBy(spread_key("key"), "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_members = materialise(labelled.join(mixed, "key").select("rep", "n", "comp").distinct(), drop=label)
    tokens = materialise(sets.join(open_members, "rep").select("rep", "n", "comp", F.explode("set").alias("token")), drop=open_members)
    shared = tokens.groupBy(spread_key("token"), "token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "df")
    ordered = (
        tokens.join(shared, "token").groupBy("rep", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        .select("rep", "n", "comp", F.size("t").alias("shared"), F.posexplode("t"))
        .select("rep", "n", "comp", "col.token", (F.col("n") - F.col("shared") + F.col("pos")).alias("at"))
    )
    prefix = materialise(ordered.where(F.col("at") <= F.col("n") - _ceil_div(F.col("n") * per_cent, 100)), drop=tokens)
    longer = prefix.select(*(F.col(c).alias(f"x_{c}") for c in ("rep", "n", "comp", "at")), "token")
    shorter = prefix.where(F.col("at") <= F.col("n") - _ceil_div(F.col("n") * 2 * per_cent, 100 + per_cent))
    pairs = longer.join(shorter, "token").where(
        "comp <> x_comp AND (n < x_n OR n = x_n AND rep < x_rep)"
        f" AND 100 * n >= {per_cent} * x_n AND {100 + per_cent} * (1 + least(x_n - x_at - 1, n - at - 1)) >= {per_cent} * (x_n + n)"
    )
    return pairs.select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b")).distinct(), [prefix]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 85, width: int = 5, rows: int = 6, bands: int = 32) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the smallest id of its component) and kept.

    Words are split at space and 0x09-0x0D and A-Z lower-cased. Rows whose shingle sets have 100 * intersection >= per_cent * union
    are linked. Sets that are equal are one node. Nodes that share the key of a band meet the smallest of
    the bucket; links are confirmed on full sets. Buckets left in more than one component then get an exact
    prefix filter, so a bucket's size is never capped. Only a pair that shares no band is missed: (1 - s ** rows) ** bands at similarity s,
    3e-7 at 0.85 with 6 rows in 32 bands and 3e-6 at 0.8 with 5.

    A null, empty or blank text has no shingles and is linked with nothing. A row with a null id keeps a null component_id and is kept.
    Rows that repeat an id are one document. An empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    table = materialise(slim.mapInArrow(_sketcher("text", width, rows, bands), f"id {kind}, n long, f1 long, f2 long, bands array<long>"))
    nodes = table.where("n > 0 AND id IS NOT NULL")
    same = nodes.groupBy(spread_key("f1", "f2"), "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialise(same.select("f1", "f2", "rep", "copies", "n", "bands"))

    buckets = reps.select("rep", "n", F.explode("bands").alias("key"))
    first = buckets.groupBy(spread_key("key"), "key").agg(F.min("rep").alias("first"), F.count("*").alias("c")).where("c > 1").select("key", "first")
    members = materialise(buckets.join(first, "key").select("key", "rep", "n", "first"))
    stars = members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    wanted = members.select(F.col("rep").alias("id")).distinct()
    sets = materialise(slim.join(wanted, "id", "left_semi").mapInArrow(_set_maker("text", width), f"rep {kind}, set array<long>"))

    edges = materialise(_linked(stars, sets, per_cent))
    rest, read = _rest_of_pairs(members, sets, edges, per_cent)
    more = materialise(_linked(rest, sets, per_cent))
    label = components(edges.union(more))
    moved = reps.join(label.withColumnRenamed("v", "rep"), "rep", "left").where("copies > 1 OR m IS NOT NULL").select("f1", "f2", F.coalesce("m", "rep").alias("m"))
    out = table.join(moved, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("m", "id")).otherwise(F.col("id"))
    out = materialise(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))
    for done in (table, reps, members, sets, edges, more, label, *read):
        discard(done)
    return out


#: DuckDB: the rows of near_duplicates() with its defaults, from all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS m FROM w UNION SELECT r.d, e.b FROM r JOIN e ON r.m = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id, w.doc_id = min(m) AS kept FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.d = w.doc_id GROUP BY w.doc_id
"""
