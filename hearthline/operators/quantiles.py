"""Exact quantiles of groups of any size, several groups and quantiles at once, without a buffer that holds a group's values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.geo import haversine_km
from hearthline.operators.lineage import cut_lineage


#: A quantile from 0 to 1, or a rank (from 1) by the number of values.
Wanted = float | Callable[[Column], Column]


def _wanted(n: Column, q: Wanted) -> tuple[Column, Column, Column]:
    """The two ranks (from 1) that quantile q of n values lies between, and how far beyond the first."""
    if callable(q):
        return q(n).cast("long"), q(n).cast("long"), F.lit(0.0)
    at = (n - 1) * F.lit(float(q))
    return F.floor(at) + 1, F.ceil(at) + 1, at - F.floor(at)


def _cuts_below(df: DataFrame, cuts: str, value: str, most: int, name: str) -> DataFrame:
    """Adds ``name``: how many of the (at most ``most``, sorted) cuts lie below a value, found by halving; 0 without cuts."""
    df, step = df.withColumn(name, F.lit(0)), 1 << most.bit_length() - 1
    while step:
        below = F.coalesce(F.get(cuts, F.col(name) + (step - 1)) < F.col(value), F.lit(False))
        df, step = df.withColumn(name, F.col(name) + F.when(below, step).otherwise(0)), step // 2
    return df


def exact_quantiles(df: DataFrame, groups: list[str], value: str, quantiles: dict[str, Wanted], most: int = 200_000, buckets: int = 256, count: str | None = None) -> DataFrame:
    """groups, n (rows that have a value) and one column per quantile, interpolated between the two values beside it, or per rank; a null key is a group. Without groups one row, nulls in it if there are no values.
    ``count``: a column of how many rows a row stands for.

    Values are counted first, so that repeated ones cost one row. A group of more than ``most`` distinct values is parted into buckets by cuts through these, the buckets' counts
    tell which of them hold a wanted rank, and only these go on, as often as it takes; what is sorted together at last has at most ``most`` values. Cuts are approximate,
    but counted values are fixed by a checkpoint before each round, so every plan sees the same buckets.
    """
    key = F.struct(*groups) if groups else F.lit(0)
    counted = df.where(F.col(value).isNotNull()).select(key.alias("g"), F.col(value).cast("double").alias("v"), (F.col(count).cast("long") if count else F.lit(1).cast("long")).alias("c")).groupBy("g", "v").agg(F.sum("c").alias("c"))
    counted = cut_lineage(counted)
    totals = counted.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("size"))
    state = counted.withColumn("b", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    ranks = lambda n: F.array(*(r for q in quantiles.values() for r in _wanted(n, q)[:2]))
    while (state.groupBy("g", "b").count().agg(F.max("count")).first()[0] or 0) > most:
        sized = state.groupBy("g", "b").agg(F.count("*").alias("size"), F.percentile_approx("v", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 20 * buckets).alias("cuts"))
        cuts = sized.where(F.col("size") > most).select("g", "b", "cuts")  # a row per ``most`` values at most
        parted = _cuts_below(state.join(F.broadcast(cuts), ["g", "b"], "left"), "cuts", "v", buckets - 1, "part").drop("cuts")
        parted = cut_lineage(parted)
        sums = parted.groupBy("g", "b", "before", "part").agg(F.sum("c").alias("s"))
        inside = Window.partitionBy("g", "b").orderBy("part")
        sums = sums.withColumn("before", F.col("before") + F.sum("s").over(inside) - F.col("s")).join(totals.drop("size"), "g")
        holds = F.exists(ranks(F.col("n")), lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("s")))
        kept = sums.where(holds).select("g", "b", "part", "before")
        state = parted.drop("before").join(kept, ["g", "b", "part"]).select("g", "v", "c", (F.col("b") * buckets + F.col("part")).alias("b"), "before")
    last = F.col("before") + F.sum("c").over(Window.partitionBy("g", "b").orderBy("v"))
    placed = state.withColumn("last", last).join(totals.drop("size"), "g")
    at = lambda r: F.max(F.when((r > F.col("last") - F.col("c")) & (r <= F.col("last")), F.col("v")))
    ends = [(name, *_wanted(F.col("n"), q)) for name, q in quantiles.items()]
    found = placed.groupBy("g", "n").agg(*(at(r).alias(f"_{i}_{k}") for i, (_, low, high, _) in enumerate(ends) for k, r in enumerate((low, high))))
    values = [(F.col(f"_{i}_0") * (1 - beyond) + F.col(f"_{i}_1") * beyond).alias(name) for i, (name, _, _, beyond) in enumerate(ends)]
    out = found.select(*(F.col(f"g.{g}").alias(g) for g in groups), "n", *values)
    if groups:
        return out
    one = df.sparkSession.range(1).select(F.lit(0).alias("_k"))
    return one.join(out.withColumn("_k", F.lit(0)), "_k", "left").drop("_k").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def column_quantiles(df: DataFrame, columns: list[str], quantiles: dict[str, Wanted], **how) -> DataFrame:
    """column, n and the quantiles of each of several columns, as groups of one long table; a column without values has no row."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    return exact_quantiles(long, ["column"], "v", quantiles, **how)


def median_places(df: DataFrame, levels: list[list[str]], **how) -> list[DataFrame]:
    """For each level's keys a table of them, lat, lon and n: the exact median place of the rows with coordinates, for groups of any size; a null key is none.

    All levels and both axes are groups of one long table, so their medians are found together.
    """
    if not levels:
        return []
    known, names = df.where("lat IS NOT NULL AND lon IS NOT NULL"), list(dict.fromkeys(k for keys in levels for k in keys))

    def group(i: int, keys: list[str]) -> Column:
        own = F.struct(F.lit(i).alias("_level"), *((F.col(k) if k in keys else F.lit(None).cast(df.schema[k].dataType)).alias(f"k_{k}") for k in names))
        return F.when(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True)), own)

    long = known.select("lat", "lon", F.explode(F.filter(F.array(*(group(i, keys) for i, keys in enumerate(levels))), lambda g: g.isNotNull())).alias("g"))
    long = long.select("g.*", F.explode(F.array(*(F.struct(F.lit(c).alias("_axis"), F.col(c).cast("double").alias("v")) for c in ("lat", "lon")))).alias("x")).select("*", "x.*").drop("x")
    by = ["_level", *(f"k_{k}" for k in names)]
    middle = exact_quantiles(long, [*by, "_axis"], "v", {"m": 0.5}, **how)
    found = middle.groupBy(*by).agg(*(F.max(F.when(F.col("_axis") == c, F.col("m"))).alias(c) for c in ("lat", "lon")), F.max("n").alias("n"))
    found = cut_lineage(found)  # a row per group; every level reads it
    return [found.where(F.col("_level") == i).select(*(F.col(f"k_{k}").alias(k) for k in keys), "lat", "lon", "n") for i, keys in enumerate(levels)]


def beside_group(df: DataFrame, table: DataFrame, groups: list[str]) -> DataFrame:
    """df with the columns of table (one row per group), a null key equal to a null key."""
    if not groups:
        return df.join(F.broadcast(table))  # one row
    named = table.withColumnsRenamed({g: f"_{g}" for g in groups})
    on = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups))
    return df.join(named, on, "left").drop(*(f"_{g}" for g in groups))


def with_iqr_outlier(df: DataFrame, value: Column, groups: list[str], name: str = "outlier", k: float = 3.0, least: int = 15, **how) -> DataFrame:
    """Adds ``name``: whether a value lies beyond k interquartile ranges from the quartiles of its group, of at least ``least`` rows. Null groups are a group; a null value is no outlier."""
    rows = df.withColumn("_v", value)
    table = exact_quantiles(rows, groups, "_v", {"_q1": 0.25, "_q3": 0.75}, **how).drop("n")
    table = beside_group(rows.groupBy(*groups).agg(F.count("*").alias("_n")), table, groups)
    out = beside_group(rows, table, groups)
    beyond = (F.col("_v") < F.col("_q1") - k * (F.col("_q3") - F.col("_q1"))) | (F.col("_v") > F.col("_q3") + k * (F.col("_q3") - F.col("_q1")))
    return out.withColumn(name, F.coalesce((F.col("_n") >= least) & beyond, F.lit(False))).drop("_v", "_q1", "_q3", "_n")


def with_stray(df: DataFrame, group: str, name: str = "stray", most_km: float = 5.0, least: int = 5, **how) -> DataFrame:
    """Adds ``name``: whether a row lies more than most_km from its group's median place, in a group of ``least`` or more rows with a place."""
    lat, lon = (exact_quantiles(df, [group], c, {f"_{c}": 0.5}, **how) for c in ("lat", "lon"))
    table = beside_group(lat.withColumnRenamed("n", "_n"), lon.drop("n"), [group])
    out = beside_group(df, table, [group])
    away = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return out.withColumn(name, F.coalesce((F.col("_n") >= least) & (away > most_km), F.lit(False))).drop("_n", "_lat", "_lon")
