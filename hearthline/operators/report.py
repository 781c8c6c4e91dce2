"""The out-of-fold table and the metrics of whole models: by branch, area and fold in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.lineage import cut_lineage
from hearthline.operators.market import position
from hearthline.operators.quantiles import exact_quantiles
from hearthline.operators.valuation import cross_validated


def out_of_fold(df: DataFrame, numbers: list[str], categories: list[str], row_id: str = "row_id", **how) -> DataFrame:
    """df's rows with a price, once each, with fold, predicted, low and high by a model that never saw the row, deviation (per cent of the prediction) and position in the interval; ``how`` as cross_validated() takes it."""
    priced = cut_lineage(cross_validated(df, numbers, categories, row_id=row_id, **how).drop("price"))
    return cut_lineage(position(df.where("price > 0").join(priced, row_id)))


def _by_level(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Every row once per level, as level and key (its columns' values, parted by ' / '), without those where one is null."""
    keys = [F.struct(F.lit(name).alias("level"), (F.concat(*[x for c in cols for x in (F.lit(" / "), F.col(c).cast("string"))][1:]) if cols else F.lit("all")).alias("key")) for name, cols in levels.items()]
    return df.withColumn("_l", F.explode(F.array(*keys))).select("*", "_l.level", "_l.key").drop("_l").where("key IS NOT NULL")


def metrics_report(df: DataFrame, levels: dict[str, list[str]], truth: str = "price", predicted: str = "predicted", fold: str = "fold") -> DataFrame:
    """level, key, n, mape and its standard deviation over the folds (mape_sd), mae, r2, median_error, within_10, within_20, covered, median_width, below, inside and above, from an out-of-fold table.

    ``levels``: by name, the columns that make a key ([] for all rows). df is read once, as counts of its equal rows; sums are made by the columns of all levels before they are dealt to
    each level, and so are the counts of equal errors and widths, whose exact medians are selected. Errors and widths are per cent; a null key is no group; rows without a prediction take no part.
    """
    columns = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    known = df.where(F.col(predicted).isNotNull() & (F.col(truth) > 0))
    known = known.select(*columns, F.col(fold).alias("_fold"), *(F.col(c).cast("double").alias(n) for c, n in ((truth, "_y"), (predicted, "_p"), ("low", "_low"), ("high", "_high"))))
    known = cut_lineage(known.groupBy(*known.columns).agg(F.count("*").alias("_c")))
    error, width = F.abs(F.col("_p") - F.col("_y")), 100 * (F.col("_high") - F.col("_low")) / 2 / F.col("_y")
    near = known.agg(F.sum(F.col("_c") * F.col("_y")) / F.sum("_c")).first()[0] or 0.0  # squares are summed about the mean of all rows, and shifted to that of a key
    rows = known.withColumns({"_abs": error, "_error": 100 * error / F.col("_y"), "_width": width})
    inside = F.col("_y").between(F.col("_low"), F.col("_high"))
    times = lambda x: F.sum(F.col("_c") * x)
    having = lambda x: times(F.when(x, 1).otherwise(0))
    cells = rows.groupBy(*columns, "_fold").agg(
        F.sum("_c").alias("n"), times(F.col("_error")).alias("e"), times(F.col("_abs")).alias("a"), times(F.col("_abs") * F.col("_abs")).alias("aa"), F.min("_y").alias("least"), F.max("_y").alias("most"), times(F.col("_y") - near).alias("y"), times((F.col("_y") - near) * (F.col("_y") - near)).alias("yy"),
        having(F.col("_error") <= 10).alias("w10"), having(F.col("_error") <= 20).alias("w20"), having(inside).alias("i"), having(F.col("_y") < F.col("_low")).alias("b"), having(F.col("_y") > F.col("_high")).alias("o"),
    )
    cells = cut_lineage(_by_level(cells, levels))
    n = F.sum("n")
    summed = cells.groupBy("level", "key", "_fold").agg(*(F.sum(c).alias(c) for c in ("n", "e", "a", "aa", "y", "yy", "w10", "w20", "i", "b", "o")), F.min("least").alias("least"), F.max("most").alias("most"))
    sums = summed.groupBy("level", "key").agg(
        n.alias("n"), (F.sum("e") / n).alias("mape"), F.stddev_pop(F.col("e") / F.col("n")).alias("mape_sd"), (F.sum("a") / n).alias("mae"), F.when(F.min("least") < F.max("most"), 1 - F.sum("aa") / F.nullif(F.sum("yy") - F.sum("y") * F.sum("y") / n, F.lit(0.0))).alias("r2"),
        *((100 * F.sum(c) / n).alias(name) for c, name in (("w10", "within_10"), ("w20", "within_20"), ("i", "covered"))), *(F.sum(c).alias(name) for c, name in (("b", "below"), ("i", "inside"), ("o", "above"))),
    )
    medians = []
    for c, name in (("_error", "median_error"), ("_width", "median_width")):
        counted = _by_level(rows.groupBy(*columns, c).agg(F.sum("_c").alias("_c")), levels)
        medians.append(exact_quantiles(counted, ["level", "key"], c, {name: 0.5}, count="_c").drop("n"))
    return reduce(lambda a, b: a.join(b, ["level", "key"]), medians, sums)


def branch_report(df: DataFrame, metrics: DataFrame, branch: str, twins: list[str | Column], value: str = "price", precise: Column | None = None, ward: str = "ward") -> DataFrame:
    """Per branch: its rows, precise (per cent of rows whose place is known well), wards with rows and how many of them have 20 or more, under 30 and under 10, twin groups and their noise (mean coefficient of variation, per cent), mape, r2 and covered from metrics (level 'branch'), and gap, mape less noise."""
    sure = F.coalesce(precise, F.lit(False)) if precise is not None else F.lit(None).cast("boolean")
    named = [F.col(t).alias(f"_t{i}") if isinstance(t, str) else t.alias(f"_t{i}") for i, t in enumerate(twins)]
    same = [branch, *(f"_t{i}" for i in range(len(twins)))]
    slim = df.select(branch, F.col(ward).alias("_ward"), *named, F.col(value).alias("_v"), sure.cast("int").alias("_sure"))
    # df is read once: groups of twins in a ward, of which all else is made
    cells = cut_lineage(slim.groupBy(*same, "_ward").agg(F.count("*").alias("n_rows"), F.sum("_sure").alias("n_sure"), F.count("_v").alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("v")))
    rows = cells.groupBy(branch).agg(F.sum("n_rows").alias("rows"), (100 * F.sum("n_sure") / F.sum("n_rows")).alias("precise"))
    wards = cells.where("_ward IS NOT NULL").groupBy(branch, "_ward").agg(F.sum("n_rows").alias("count")).groupBy(branch).agg(
        F.count("*").alias("wards"), F.count_if(F.col("count") >= 20).alias("wards_20"), F.count_if(F.col("count") < 30).alias("wards_under_30"), F.count_if(F.col("count") < 10).alias("wards_under_10"))
    over = Window.partitionBy(*same)
    middle = F.sum(F.col("n") * F.col("m")).over(over) / F.sum("n").over(over)
    twice = cells.where("n > 0").withColumn("middle", middle).groupBy(*same).agg(F.sum("n").alias("n"), F.first("middle").alias("middle"), F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("middle")) * (F.col("m") - F.col("middle")))).alias("squares"))
    twice = twice.where("n >= 2").withColumn("cv", F.sqrt(F.col("squares") / (F.col("n") - 1)) / F.col("middle"))
    noise = twice.groupBy(branch).agg(F.count("*").alias("twins"), (100 * F.avg("cv")).alias("noise"))
    rates = metrics.where("level = 'branch'").select(F.col("key").alias(branch), "mape", "r2", "covered")
    out = rows.join(wards, branch, "left").join(noise, branch, "left").join(rates, branch, "left")
    return out.withColumn("gap", F.col("mape") - F.col("noise"))
