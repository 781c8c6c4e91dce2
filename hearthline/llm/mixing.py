"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.storage import discard, free_name, materialise

#: Seeded starts tried for each source's sample; the one that comes nearest to the source's target is taken.
STARTS = 32


def _beside(rows: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """rows with the columns of more that has the same keys, null equal to null."""
    named = more.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, on).drop(*(f"_{k}" for k in keys))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds target to rows (source, source_size, weight): share times all sizes, dealt by weight, none above most times its source's size.

    With sources in order of cap / weight, those before some place are full and the rest get level * weight; the level
    is (what is left) / (weights left) at the first place whose source it does not overfill. This is the fixed point of clamping and resharing
    the excess. The rows are one per source: a sort of the sources' totals, not of documents.
    """
    full = F.col("source_size") * F.lit(most)
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    return (
        sources.withColumn("cap", full).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"])
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .drop("cap", "ratio", "level")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: str | None = None) -> DataFrame:
    """Per row of docs: id, source, size, source_size, target, copies and taken (copies * size).

    Size is the number of words. Sources by code point, null last, weigh ``weights`` in turn. A source's rate is target / source_size: each document is
    taken floor(rate) times, and a seeded systematic sample of rate - floor(rate) of them once more. The sample runs
    along the source in order of size, so that it holds its part of the long and of the short ones; it may start at STARTS places, and the one
    nearest to the target is used. Reruns agree whatever the partitioning: ranks are by size and a hash of seed and id.

    A null text has size 0; a null source is one source; rows with equal ids, null ones too, are dealt as rows of their own.
    A source of size 0 has target 0 and nothing taken. ``carry`` names a further column to return, as a key for joining.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), (F.col(carry) if carry else F.lit(None).cast("long")).alias("carry"))
    slim = slim.withColumn("tie", F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 16))
    # Ranks within a source without a task per source: ranges in order, each counted, then ranked inside.
    slim = materialise(slim)  # words are counted once: dealing by range reads its rows twice
    ranged = materialise(slim.repartitionByRange(F.col("source").asc_nulls_last(), F.col("size"), F.col("tie")).withColumn("part", F.spark_partition_id()), drop=slim)
    parts = ranged.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    totals = parts.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("weight", weight)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    totals = materialise(water_fill(totals, share, most).withColumn("whole", F.floor(rate)).withColumn("part_of", rate - F.floor(rate)))

    ranked = ranged.withColumn("k", F.row_number().over(Window.partitionBy("source", "part").orderBy("size", "tie")) - 1)
    ranked = _beside(ranked, starts, "source", "part").withColumn("k", F.col("k") + F.col("skip"))
    ranked = materialise(_beside(ranked, totals, "source").select("id", "source", "size", "carry", "source_size", "target", "whole", "part_of", "k"))
    discard(ranged)

    def extra(start: Column) -> Column:
        return F.floor((F.col("k") + 1) * F.col("part_of") + start) - F.floor(F.col("k") * F.col("part_of") + start)

    tries = [(j + 0.5) / STARTS for j in range(STARTS)]
    sums = ranked.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("s"), F.first("whole").alias("w"), *(F.sum(F.col("size") * extra(F.lit(u))).alias(f"t{j}") for j, u in enumerate(tries)))
    off = F.array(*(F.struct(F.abs(F.col(f"t{j}") + F.col("w") * F.col("s") - F.col("target")).alias("off"), F.lit(u).alias("start")) for j, u in enumerate(tries)))
    chosen = sums.select("source", F.array_min(off)["start"].alias("start"))
    out = _beside(ranked, chosen, "source").withColumn("copies", F.col("whole") + extra(F.col("start")))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([F.col("carry").alias(carry)] if carry else []))


def repeat(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as mix(docs, **how) takes them, with a column copy (copy_ if docs has one) that counts from 1. Rows not taken go."""
    row, copy = free_name(docs, "row"), free_name(docs, "copy")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mix(keyed, carry=row, **how).select(F.col(row), F.col("copies").alias(copy)).where(F.col(copy) > 0)
    return keyed.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int")))).select(*docs.columns, copy)


#: DuckDB: the rows of mix() with its defaults.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(concat_ws(':', '0', doc_id::VARCHAR)), 1, 16) AS tie
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM l
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), k AS (
  SELECT d.doc_id, d.source, d.size, q.source_size, q.target, floor(q.rate) AS whole, q.rate - floor(q.rate) AS part_of,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie) - 1 AS k
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), u AS (SELECT (j + 0.5::DOUBLE) / 32 AS start FROM range(32) x(j)), e AS (
  SELECT source, start, abs(sum(size * (floor((k + 1) * part_of + start) - floor(k * part_of + start))) + any_value(whole) * any_value(source_size) - any_value(target)) AS off
  FROM k, u GROUP BY source, start
), c AS (SELECT source, start FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, start) = 1)
SELECT doc_id, k.source, size, source_size, target, (whole + floor((k + 1) * part_of + start) - floor(k * part_of + start))::BIGINT AS copies,
       ((whole + floor((k + 1) * part_of + start) - floor(k * part_of + start)) * size)::BIGINT AS taken
FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source
"""
