"""Cleaning listings: de-duplication, unit repair, outliers, ledgers. Every operator takes an explicit row id and no row order is assumed."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.lineage import cut_lineage
from hearthline.operators.quantiles import exact_quantiles


def keep_first(df: DataFrame, keys: list[str | Column], row_id: str = "row_id") -> DataFrame:
    """The row of the smallest row_id for each key; null keys are equal to one another."""
    w = Window.partitionBy(*keys).orderBy(row_id)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def prefer_first(df: DataFrame, key: str, better: Column, row_id: str = "row_id") -> DataFrame:
    """One row per key, one for which ``better`` holds if there is one; rows with a null key stay as they are."""
    w = Window.partitionBy(key).orderBy(F.coalesce(better, F.lit(False)).desc(), row_id)
    keyed = df.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return keyed.unionByName(df.where(F.col(key).isNull()))


def outside_band(value: Column, low: float, high: float) -> Column:
    """Outside [low, high]; a missing value is outside."""
    return F.coalesce(~value.between(low, high), F.lit(True))


def plausible_band(df: DataFrame, value: Column, low: float, high: float, least: int = 50) -> DataFrame:
    """One row (lo, hi): the 1st and 99th percentile of values in [low, high], or low and high if fewer than ``least`` are."""
    inside = F.when(value.between(low, high), value)
    agg = exact_quantiles(df.select(inside.alias("v")), [], "v", {"p01": 0.01, "p99": 0.99})
    return agg.select(F.when(F.col("n") >= least, F.col("p01")).otherwise(float(low)).alias("lo"), F.when(F.col("n") >= least, F.col("p99")).otherwise(float(high)).alias("hi"))


def repair_units(df: DataFrame, band: DataFrame, low: float, high: float, price: str = "price", area: str = "area") -> DataFrame:
    """Adds price_fixed and fix ('/1000', '*1000' or null): a price per area beyond [low, high] is scaled if that brings it into the band (one row: lo, hi)."""
    ppm2 = F.when(F.col(area) > 0, F.col(price) / F.col(area))
    down = (ppm2 > high) & (ppm2 / 1000).between(F.col("lo"), F.col("hi"))
    up = (ppm2 < low) & (ppm2 * 1000).between(F.col("lo"), F.col("hi"))
    fix = F.when(down, "/1000").when(up, "*1000")
    out = df.join(F.broadcast(band))
    return out.withColumn("fix", fix).withColumn("price_fixed", F.when(F.col("fix") == "/1000", F.col(price) / 1000).when(F.col("fix") == "*1000", F.col(price) * 1000).otherwise(F.col(price))).drop("lo", "hi")


def reject_reason(steps: list[tuple[str, Column]]) -> Column:
    """The first step that a row fails (its condition true), null if none."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in steps))


def ledger(df: DataFrame, steps: list[str], reason: str = "reason") -> DataFrame:
    """step, place, rows_in, removed, kept, percent: from rows that carry the first step they fail, in one aggregate."""
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(reason) == s).alias(f"r{i}") for i, s in enumerate(steps)))
    gone = [F.lit(0)]
    for i in range(len(steps)):
        gone.append(gone[-1] + F.col(f"r{i}"))
    rows = F.array(*(F.struct(F.lit(s).alias("step"), F.lit(i).alias("place"), (F.col("n") - gone[i]).alias("rows_in"), F.col(f"r{i}").alias("removed"), (F.col("n") - gone[i + 1]).alias("kept")) for i, s in enumerate(steps)))
    out = counts.select(F.explode(rows).alias("x")).select("x.*")
    return out.withColumn("percent", F.round(F.when(F.col("rows_in") > 0, 100.0 * F.col("removed") / F.col("rows_in")).otherwise(0.0), 2))


#: Fixed value: a word of two or more letters.
WORD = re.compile(r"\b\w\w+\b")


def _terms(texts: pd.Series) -> pd.Series:
    """Words of two or more letters and pairs of such in a row."""
    return texts.str.findall(r"\b\w\w+\b").map(lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])


#: So many texts are counted at once: a Python worker holds the terms of these, whatever a batch brings.
TEXTS = 256


def tallies(texts: list[str | None]) -> Iterator[list[tuple[str, int]]]:
    """Of each text its terms, sorted, with how often each occurs; a null text has none."""
    for t in texts:
        words = WORD.findall((t or "").lower())
        yield sorted(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]).items())


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """counted_terms() of a batch whose last column is the text, a few texts at once."""
    for at in range(0, batch.num_rows, TEXTS):
        part = batch.slice(at, TEXTS)
        texts = part.column(part.num_columns - 1).to_pylist()
        found = list(tallies(texts))
        pairs = pa.StructArray.from_arrays([pa.array([t for f in found for t, _ in f], pa.string()), pa.array([n for f in found for _, n in f], pa.int64())], names=["term", "n"])
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        long = pa.array([len((t or "").lower()) >= 20 for t in texts], pa.bool_())
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], long, pa.ListArray.from_arrays(ends, pairs)], names=[*part.schema.names[:-1], "long", "terms"])


def counted_terms(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, long (whether a text has 20 or more characters) and terms (an array of structs term, n, sorted), a row per row."""
    slim = df.select(*keep, F.col(text).cast("string").alias("_text"))
    own = "".join(f"`{c}` {slim.schema[c].dataType.simpleString()}, " for c in keep)
    return slim.mapInArrow(lambda batches: (out for batch in batches for out in _counted(batch)), f"{own}long boolean, terms array<struct<term:string,n:long>>")


def _large_leaders(df: DataFrame, block: list[str], text: str, row_id: str, cut: float) -> DataFrame:
    """The leaders of similar_leaders() by joins, for blocks of any size.

    Rows of equal terms share a leader and are compared once. Two texts can only reach ``cut`` if they share a term among the first ones, the rarest
    first, that are needed until the rest of the vector is shorter than ``cut``; such pairs are scored in full. Then, in rounds, rows without an undecided
    earlier neighbour are kept and their neighbours go. The work grows with the pairs that are near, the rounds with the longest chain of such pairs.
    """
    rows = counted_terms(df.select(F.col(row_id).alias("id"), F.struct(*block).alias("b"), F.col(text).alias("text")), "text", "id", "b")
    rows = cut_lineage(rows.withColumn("key", F.sha2(F.to_json("terms"), 256)))
    blocks = rows.groupBy("b").agg(F.count("*").alias("rows")).join(rows.where("long").select("b").distinct(), "b", "left_semi")
    vectors = rows.where(F.size("terms") > 0).groupBy("b", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("terms").alias("terms")).join(blocks, "b")
    counts = vectors.select("b", "rep", "rows", "copies", F.explode("terms").alias("x")).select("b", "rep", "rows", "copies", "x.*")
    seen = counts.groupBy("b", "term").agg(F.sum("copies").alias("df"))
    weighted = counts.join(seen, ["b", "term"]).withColumn("w", F.col("n") * (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1))
    own = Window.partitionBy("rep")
    square = F.pow("w", F.lit(2))
    before = F.sum(square).over(own.orderBy("df", "term")) - square
    total = F.sum(square).over(own)
    weighted = cut_lineage(weighted.select("b", "rep", "term", (F.col("w") / F.sqrt(total)).alias("w"), ((total - before) / total >= (cut - 1e-9) ** 2).alias("first")))
    first = weighted.where("first").select("b", "term", "rep")
    pairs = first.withColumnRenamed("rep", "i").join(first.withColumnRenamed("rep", "j"), ["b", "term"]).where("i < j").select("i", "j").distinct()
    left, right = (weighted.select(F.col("rep").alias(c), "term", F.col("w").alias(f"w{c}")) for c in "ij")
    edges = cut_lineage(pairs.join(left, "i").join(right, ["j", "term"]).groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("score")).where(F.col("score") >= cut - 1e-12).select("i", "j"))
    gone, undecided = edges.select("j").limit(0), edges
    while True:
        kept = undecided.select("i").distinct().join(undecided.select(F.col("j").alias("i")), "i", "left_anti")
        out = cut_lineage(undecided.join(kept, "i", "left_semi").select("j").distinct())
        if out.isEmpty():
            break
        gone = gone.unionByName(out)
        undecided = cut_lineage(undecided.join(out, "j", "left_anti").join(out.withColumnRenamed("j", "i"), "i", "left_anti"))
    leader = edges.join(gone.withColumnRenamed("j", "i"), "i", "left_anti").groupBy(F.col("j").alias("rep")).agg(F.min("i").alias("leader"))
    led = vectors.select("b", "key", "rep").join(leader, "rep", "left").select("b", "key", F.coalesce("leader", "rep").alias("leader"))
    return rows.join(led, ["b", "key"], "left").select(F.col("id").alias(row_id), F.coalesce("leader", "id").alias("leader"))


def similar_leaders(df: DataFrame, block: list[str], text: str, row_id: str = "row_id", cut: float = 0.9, most: int = 800) -> DataFrame:
    """row_id and leader: in each block, in order of row_id, a text whose TF-IDF cosine with a kept one is ``cut`` or more goes to the first such; others are kept (leader = row_id).

    Terms are one and two words in a row; blocks of one row keep it, and blocks where all texts are shorter than 20 characters keep all. row_id is unique.
    Blocks of up to ``most`` rows are worked out in one task each, larger ones by joins, with the same leaders; so a task never holds more than ``most`` texts of a block.
    """
    sized = df.withColumn("_n", F.count("*").over(Window.partitionBy(*block)))
    alone = sized.where("_n < 2").select(row_id, F.col(row_id).alias("leader"))
    kind = df.schema[row_id].dataType.simpleString()

    def lead(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(row_id)
        texts = rows[text].fillna("").str.lower()
        leader = rows[row_id].to_numpy().copy()
        if (texts.str.len() >= 20).any():
            terms = _terms(texts)
            place: dict[str, int] = {}
            counts = [np.unique([place.setdefault(t, len(place)) for t in ts], return_counts=True) if ts else (np.zeros(0, int), np.zeros(0, int)) for ts in terms]
            df_ = np.bincount(np.concatenate([c[0] for c in counts]), minlength=max(len(place), 1))
            idf = np.log((1 + len(rows)) / (1 + df_)) + 1
            kept: dict[int, list[tuple[int, float]]] = {}
            for i, (at, n) in enumerate(counts):
                weight = n * idf[at]
                norm = np.sqrt((weight**2).sum())
                if not norm:
                    continue
                weight = weight / norm
                score: dict[int, float] = {}
                for t, w in zip(at.tolist(), weight.tolist()):
                    for j, x in kept.get(t, ()):
                        score[j] = score.get(j, 0.0) + w * x
                if near := [j for j, s in score.items() if s >= cut - 1e-12]:
                    leader[i] = leader[min(near)]
                else:
                    for t, w in zip(at.tolist(), weight.tolist()):
                        kept.setdefault(t, []).append((i, w))
        return pd.DataFrame({row_id: rows[row_id].to_numpy(), "leader": leader})

    grouped = sized.where((F.col("_n") >= 2) & (F.col("_n") <= most)).select(row_id, *block, text)
    out = alone.unionByName(grouped.groupBy(*block).applyInPandas(lead, f"{row_id} {kind}, leader {kind}"))
    if df.groupBy(*block).count().where(F.col("count") > most).isEmpty():
        return out
    return out.unionByName(_large_leaders(sized.where(F.col("_n") > F.greatest(F.lit(most), F.lit(1))), block, text, row_id, cut))


def upsert(events: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """key, first_seen, last_seen, sightings and the latest payload (of equal times the greatest)."""
    return events.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("sightings"), F.max(F.struct(at, payload))[payload].alias("latest"))


def pending(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Queued rows, one per key, that are not done."""
    return queue.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def union_sources(named: dict[str, DataFrame], column: str = "source") -> DataFrame:
    """All rows with the name of their source; columns that one lacks are null."""
    parts: Iterator[DataFrame] = iter(df.withColumn(column, F.lit(name)) for name, df in named.items())
    out = next(parts)
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
