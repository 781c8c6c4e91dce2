"""Connected components by alternating large and small stars, each a grouped minimum joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.storage import discard, materialise, spread_key


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the smallest of u and of all v beside it. A node with very many neighbours is combined before the shuffle, and its rows of the join may be split."""
    least = pairs.groupBy(spread_key("u"), "u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v) to (v, m) for every node v that is not the smallest of its component; m is the smallest.

    Loops, repeated and reversed edges are allowed; no edges give no rows. Every round halves the
    depth of the trees or better; the loop ends when a round changes nothing.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_minimum(materialised := materialise(large))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialise(small, drop=now)
        discard(materialised)
        before, state = state, _state(now)
    out = now.select(F.col("u").alias("v"), F.col("v").alias("m"))
    out._llm_path = now._llm_path  # for discard()
    return out
