"""Prices learnt without leaks: target encodings by fold, boosted trees, conformal intervals, and how good they are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.lineage import cut_lineage, over_cores
from hearthline.operators.quantiles import exact_quantiles
from hearthline.operators.textmodel import COMPONENTS, fit_text


def fold_of(row_id: Column, folds: int = 5) -> Column:
    """A fold by a hash of the row's id, the same in every engine that has MD5."""
    return F.pmod(F.conv(F.substring(F.md5(row_id.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def encode(df: DataFrame, key: str, target: Column, weight: float = 10.0, fold: str | None = None) -> DataFrame:
    """Adds enc_<key>: (mean * n + overall * weight) / (n + weight) over the rows of the key; with ``fold``, over those of the other folds.

    All folds come from one aggregate by key and fold: a fold's statistics are the totals less its own. Unseen and null keys get the overall mean.
    """
    part = [fold] if fold else []
    cells = df.groupBy(key, *part).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    totals = df.agg(F.sum(target).alias("all_s"), F.count(target).alias("all_n"))  # one row
    mine = cells.join(F.broadcast(totals))
    if fold:
        own = df.groupBy(fold).agg(F.sum(target).alias("own_s"), F.count(target).alias("own_n"))  # one row per fold
        mine = mine.join(F.broadcast(own), fold).withColumn("all_s", F.col("all_s") - F.col("own_s")).withColumn("all_n", F.col("all_n") - F.col("own_n"))
        mine = mine.withColumn("s", F.sum("s").over(Window.partitionBy(key)) - F.col("s")).withColumn("n", F.sum("n").over(Window.partitionBy(key)) - F.col("n"))
    overall = F.col("all_s") / F.col("all_n")
    value = F.when(F.col(key).isNull(), overall).otherwise((F.col("s") + overall * weight) / (F.col("n") + weight))
    table = mine.select(F.col(key).alias("_key"), *(F.col(f).alias("_fold") for f in part), value.alias(f"enc_{key}"))
    on = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(table, on & (F.col(fold) == F.col("_fold")) if fold else on, "left").drop("_key", "_fold")


def conformal_offset(scores: DataFrame, score: str, alpha: float = 0.1, groups: list[str] | None = None) -> DataFrame:
    """groups, n and offset: the order statistic of the conformity scores at level min(ceil((n + 1)(1 - alpha)) / n, 1), taken at the next higher rank."""
    rank = lambda n: F.ceil(F.least(F.ceil((n + 1) * (1 - alpha)) / n, F.lit(1.0)) * (n - 1)) + 1
    return exact_quantiles(scores, groups or [], score, {"offset": rank}).where("n > 0")


def accuracy(df: DataFrame, groups: list[str] | None = None, truth: str = "price", predicted: str = "predicted") -> DataFrame:
    """n, mape, median error (per cent), mae, r2 and the share within 10 and 20 per cent."""
    error = F.abs(F.col(predicted) - F.col(truth))
    relative = error / F.col(truth)
    return df.groupBy(*(groups or [])).agg(
        F.count("*").alias("n"), (100 * F.avg(relative)).alias("mape"), (100 * F.median(relative)).alias("median_error"), F.avg(error).alias("mae"),
        (1 - F.sum(error * error) / (F.var_pop(truth) * F.count("*"))).alias("r2"), F.avg((relative <= 0.1).cast("double")).alias("within_10"), F.avg((relative <= 0.2).cast("double")).alias("within_20"),
    )


def coverage(df: DataFrame, groups: list[str], low: str = "low", high: str = "high", truth: str = "price", least: int = 20) -> DataFrame:
    """Per group of ``least`` or more: share of truths within the interval, and mean and median relative half-width."""
    width = (F.col(high) - F.col(low)) / 2 / F.col(truth)
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(F.col(truth).between(F.col(low), F.col(high)).cast("double")).alias("covered"), F.avg(width).alias("mean_width"), F.median(width).alias("median_width")).where(F.col("n") >= least)


def noise_floor(df: DataFrame, groups: list[str | Column], value: str) -> DataFrame:
    """twins: groups of two or more equal listings; noise: the plain mean of their coefficients of variation, in per cent."""
    cv = df.groupBy(*groups).agg(F.count(value).alias("n"), (F.stddev_samp(value) / F.avg(value)).alias("cv")).where("n >= 2")
    return cv.agg(F.count("*").alias("twins"), (100 * F.avg("cv")).alias("noise"))


def grade(n_ward: Column, n_district: Column, width: Column) -> Column:
    """high, medium or low by how many listings of the ward and district stand behind a value and, for high, a half-width of its interval below 45 per cent."""
    return F.when((n_ward >= 30) & (width < 45), "high").when((n_ward >= 10) | (n_district >= 60), "medium").otherwise("low")


def encoding_table(train: DataFrame, key: str, target: Column, weight: float = 10.0) -> DataFrame:
    """key and enc: what encode() gives the keys of train from all of its rows."""
    cells = train.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    overall = train.agg(F.avg(target).alias("mean"))
    return cells.join(F.broadcast(overall)).select(F.col(key).alias("_key"), ((F.col("s") + F.col("mean") * weight) / (F.col("n") + weight)).alias("enc"), "mean")


@dataclass(frozen=True)
class Appraiser:
    """What rows need to be priced: medians for missing numbers, encodings of categories, the trees, and the half-width (in logarithms) of a conformal interval.

    ``train`` holds the rows the trees were fitted to, with their features; the encodings of these leave out the part that a row is in.
    """

    numbers: list[str]
    categories: list[str]
    medians: dict[str, float]
    overall: float
    tables: dict[str, DataFrame]
    model: GBTRegressionModel
    offset: DataFrame
    train: DataFrame

    @property
    def inputs(self) -> list[str]:
        return [*self.numbers, *(f"{c}_missing" for c in self.numbers), *(f"enc_{c}" for c in self.categories)]

    def features(self, df: DataFrame) -> DataFrame:
        """df with the inputs, medians in place of missing numbers, and with them as a vector."""
        for c, table in self.tables.items():
            df = df.join(table, F.col(c) == F.col("_key"), "left").drop("_key").fillna(self.overall, [f"enc_{c}"])
        return _features(df, self.numbers, self.medians, self.inputs)

    def price(self, df: DataFrame) -> DataFrame:
        """df with its features, predicted, low and high."""
        seen = self.model.transform(self.features(df)).join(F.broadcast(self.offset.select("offset")))
        return seen.withColumns({"predicted": F.expm1("p"), "low": F.expm1(F.col("p") - F.col("offset")), "high": F.expm1(F.col("p") + F.col("offset"))}).drop("p", "offset")


def _features(df: DataFrame, numbers: list[str], medians: dict[str, float], inputs: list[str]) -> DataFrame:
    flagged = df.select("*", *(F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in numbers))
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(flagged.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in numbers}))


def fit(df: DataFrame, numbers: list[str], categories: list[str], alpha: float = 0.1, row_id: str = "row_id", trees: int = 20, depth: int = 5, folds: int = 5) -> Appraiser:
    """An Appraiser of the rows with a price: boosted trees on log(1 + price), fitted to three quarters of them; the interval comes from the others.

    All that is learnt comes from the rows the trees are fitted to: medians, and encodings, which for these rows leave out the part that a row is in.
    """
    text = F.col(row_id).cast("string")
    base = df.where("price > 0").withColumn("y", F.log1p("price")).withColumn("calibrate", fold_of(F.concat(F.lit("c"), text), 4) == 0).withColumn("part", fold_of(F.concat(F.lit("p"), text), folds))
    base = cut_lineage(over_cores(base, row_id))
    fitted, held = base.where("NOT calibrate"), base.where("calibrate")
    known = fitted.agg(F.count("*").alias("_rows"), F.avg("y").alias("_overall"), *(F.percentile_approx(c, 0.5, 10_000).alias(c) for c in numbers)).first()
    medians, overall = {c: float(known[c] or 0.0) for c in numbers}, float(known["_overall"] or 0.0)
    inputs = [*numbers, *(f"{c}_missing" for c in numbers), *(f"enc_{c}" for c in categories)]
    train, tables = fitted, {}
    for c in categories:
        tables[c] = encoding_table(fitted, c, F.col("y")).select("_key", F.col("enc").alias(f"enc_{c}"))
        train = encode(train, c, F.col("y"), fold="part").fillna(overall, [f"enc_{c}"])
    train = cut_lineage(over_cores(_features(train, numbers, medians, inputs), row_id, known["_rows"]))  # every level of every tree passes over these
    model = GBTRegressor(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=42, predictionCol="p").fit(train)
    out = Appraiser(numbers, categories, medians, overall, tables, model, train.limit(0), train)
    scores = model.transform(out.features(held)).select(F.abs(F.col("y") - F.col("p")).alias("s"))
    return replace(out, offset=conformal_offset(scores, "s", alpha))


def cross_validated(
    df: DataFrame, numbers: list[str], categories: list[str], folds: int = 5, alpha: float = 0.1, row_id: str = "row_id", trees: int = 20, depth: int = 5,
    text: str | None = None, components: int = COMPONENTS, by_fold: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> DataFrame:
    """row_id, price, fold, predicted, low and high: each fold priced by what fit() learns from the others.

    ``text``: a column whose TF-IDF components, fitted to the other folds' texts, join the numbers. ``by_fold``: a function of the other folds' rows and the fold's own that gives
    both back with more columns, for features made of other rows' prices; those named in ``numbers`` or ``categories`` are used.
    """
    base, out = cut_lineage(over_cores(df.where("price > 0").withColumn("fold", fold_of(F.col(row_id), folds)), row_id)), None
    for k in range(folds):
        train, test, more = base.where(f"fold <> {k}"), base.where(f"fold = {k}"), []
        if by_fold:
            train, test = by_fold(train, test)
        if text:
            model = fit_text(train, text, components)
            more = [f"txt_{i}" for i in range(model.loadings.shape[1])]
            train, test = model.transform(train, text), model.transform(test, text)
        appraiser = fit(train, [*numbers, *more], categories, alpha, row_id, trees, depth, folds)
        part = appraiser.price(test).select(row_id, "price", "fold", "predicted", "low", "high")
        out = part if out is None else out.unionByName(part)
    return out


def fold_accuracy(df: DataFrame, fold: str = "fold") -> DataFrame:
    """One row of what the folds' accuracies average to: folds, mape, mape_sd (over the folds), mae and r2."""
    return accuracy(df, [fold]).agg(F.count("*").alias("folds"), F.avg("mape").alias("mape"), F.stddev_pop("mape").alias("mape_sd"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"))


def quantile_forest(train: DataFrame, test: DataFrame, inputs: list[str], target: str, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95), trees: int = 10, row_id: str = "row_id") -> DataFrame:
    """row_id with q05, q50, ...: quantiles of the training targets in a row's leaves, averaged over the trees of a random forest. Leaves are joined, so no row's neighbours pass through the driver."""
    ready = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip")
    train = cut_lineage(over_cores(train, row_id) if row_id in train.columns else train)
    model = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=6, seed=42, leafCol="leaf").fit(ready.transform(train))
    def split(df: DataFrame, *keep: str) -> DataFrame:
        return model.transform(ready.transform(df)).select(*keep, F.posexplode(vector_to_array("leaf")).alias("tree", "leaf"))

    # a leaf's quantiles come from one grouped sketch of bounded size, and a row's are their means over the trees
    names = [f"q{round(100 * q):02d}" for q in quantiles]
    inside = split(train, target).groupBy("tree", "leaf").agg(F.percentile_approx(target, F.array(*map(F.lit, quantiles)), 10_000).alias("qs"))
    found = split(test, row_id).join(inside, ["tree", "leaf"]).groupBy(row_id)
    return found.agg(*(F.avg(F.col("qs")[i]).alias(n) for i, n in enumerate(names)))


def contributions(row: DataFrame, weights: dict[str, float], means: dict[str, float], row_id: str = "row_id") -> DataFrame:
    """row_id, feature, share, percent, step: what each feature of an additive log-price model adds, largest first, and the running price that ends in the prediction."""
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), (w * (F.coalesce(F.col(c), F.lit(means[c])) - means[c])).alias("share")) for c, w in weights.items()))
    out = row.select(row_id, F.explode(parts).alias("x")).select(row_id, "x.*")
    order = Window.partitionBy(row_id).orderBy(F.desc(F.abs("share")), "feature")
    return out.withColumn("percent", 100 * F.expm1("share")).withColumn("place", F.row_number().over(order)).withColumn("step", F.exp(F.sum("share").over(order)))


def slope(df: DataFrame, x: Column, y: Column, groups: list[str] | None = None) -> DataFrame:
    """Least squares of y on x: n, slope, intercept, and the slope's standard error."""
    d = df.select(*(groups or []), x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    agg = d.groupBy(*(groups or [])).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    residual = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    return agg.withColumn("error", F.sqrt(residual / (F.col("n") - 2) / F.col("sxx"))).drop("sxx", "syy")

