"""What is served with a model: bundles that are rejected with a reason when they don't fit, what-if tables, weights with their uncertainty."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.quantiles import beside_group, exact_quantiles

VERSION = 1


def fingerprint(config: dict) -> str:
    """Sixteen hex digits that change with any value of the configuration, in whatever order its keys are."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


def data_fingerprint(df: DataFrame, columns: list[str]) -> str:
    """Sixteen hex digits of the rows' values, whatever their order."""
    row = F.xxhash64(*columns)
    return "%016x" % ((df.agg(F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"), F.count("*").alias("n")).select(F.xxhash64("x", "n")).first()[0]) % (1 << 64))


def save_bundle(path: str, model: PipelineModel, encoders: DataFrame, config: dict) -> None:
    """Model, encoders and, last, the manifest, so that a bundle half written has none."""
    spark = encoders.sparkSession
    model.write().overwrite().save(f"{path}/model")
    encoders.write.mode("overwrite").parquet(f"{path}/encoders")
    manifest = json.dumps({"version": VERSION, "fingerprint": fingerprint(config), "config": config}, sort_keys=True)
    spark.range(1).select(F.lit(manifest).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str, config: dict) -> tuple[PipelineModel, DataFrame] | str:
    """The model and encoders, or the reason why the bundle is not used."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        return f"no manifest: {type(e).__name__}"
    if manifest["version"] != VERSION:
        return f"version {manifest['version']}, not {VERSION}"
    if manifest["fingerprint"] != fingerprint(config):
        return "another configuration"
    try:
        return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/encoders")
    except Exception as e:
        return f"a part is missing: {type(e).__name__}"


#: How far a what-if price can be trusted, by the listings that have the value: 30 or more, 10 or more, fewer.
TRUST = {"enough": 30, "some": 10, "few": 0}


def support_of(rows: DataFrame, alternatives: dict[str, list], listings: DataFrame, row_id: str, least: int = 30) -> DataFrame:
    """row_id, feature, value, n: how many listings of the row's area have the value. The area is its ward if that has ``least`` listings or the row has no district, else its district; a row with neither is held against all.

    Listings that have none of the values are dropped before anything is counted, and counts are of (area, feature, value), so what is shuffled does not grow with the listings of an area.
    """
    cases = [F.struct(F.lit(c).alias("feature"), F.lit(v).cast(listings.schema[c].dataType).cast("string").alias("value")) for c, vs in alternatives.items() for v in vs]
    held = F.array_compact(F.array(*(F.when(F.col(c).isin(vs), F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))) for c, vs in alternatives.items())))
    area = lambda level, c: F.struct(F.lit(level).alias("level"), F.col(c).cast("string").alias("area") if c else F.lit("").alias("area"))
    spread = listings.select(held.alias("held"), F.array(area("ward", "ward"), area("district", "district"), area("all", None)).alias("areas")).where(F.size("held") > 0)
    counts = spread.select(F.explode("areas").alias("a"), "held").where("a.area IS NOT NULL").select("a.*", F.explode("held").alias("h")).select("level", "area", "h.*").groupBy("level", "area", "feature", "value").agg(F.count("*").alias("n"))
    wards = listings.where("ward IS NOT NULL").groupBy(F.col("ward").cast("string").alias("_ward")).agg(F.count("*").alias("_n"))
    own = rows.select(row_id, F.col("ward").cast("string").alias("_ward"), F.col("district").cast("string").alias("_district")).join(wards, "_ward", "left")
    by_ward = F.col("_ward").isNotNull() & ((F.coalesce("_n", F.lit(0)) >= least) | F.col("_district").isNull())
    level = F.when(by_ward, "ward").when(F.col("_district").isNotNull(), "district").otherwise("all")
    asked = own.select(row_id, level.alias("level"), F.when(by_ward, F.col("_ward")).otherwise(F.coalesce("_district", F.lit(""))).alias("area"), F.explode(F.array(*cases)).alias("c")).select(row_id, "level", "area", "c.*")
    return asked.join(counts, ["level", "area", "feature", "value"], "left").select(row_id, "feature", "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def what_if(rows: DataFrame, alternatives: dict[str, list], price: Callable[[DataFrame], DataFrame], listings: DataFrame | None = None, row_id: str = "row_id", least: int = 30) -> DataFrame:
    """row_id, feature, now, value, before, predicted, gap and change (per cent, one decimal) for each row with one feature replaced at a time by each value that it does not have, priced in one batch by ``price`` (adds predicted).

    With ``listings`` also n, how many of them stand behind the value (``support_of``), and trust (TRUST). The best supported come first, among them the widest changes; nothing is hidden. ``now`` is null if the row lacks the feature.
    """
    value = lambda c, v: F.lit(v).cast(rows.schema[c].dataType)
    nothing = F.lit(None).cast("string")
    cases = [F.struct(nothing.alias("feature"), nothing.alias("now"), nothing.alias("value"))]
    cases += [F.when(~F.col(c).eqNullSafe(value(c, v)), F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("now"), value(c, v).cast("string").alias("value"))) for c, vs in alternatives.items() for v in vs]
    wide = rows.withColumn("case", F.explode(F.array_compact(F.array(*cases))))
    for c in alternatives:
        wide = wide.withColumn(c, F.when(F.col("case.feature") == c, F.col("case.value").cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    priced = price(wide).select(row_id, "case.*", "predicted")
    base = priced.where("feature IS NULL").select(row_id, F.col("predicted").alias("before"))
    out = priced.where("feature IS NOT NULL").join(base, row_id).withColumn("gap", F.col("predicted") - F.col("before")).withColumn("change", F.round(100 * (F.col("predicted") / F.col("before") - 1), 1))
    order = [F.desc(F.abs("change")), F.asc("feature"), F.asc("value"), F.asc(row_id)]
    if listings is None:
        return out.orderBy(*order)
    out = out.join(support_of(rows, alternatives, listings, row_id, least), [row_id, "feature", "value"])
    enough, some, few = TRUST
    trust = F.when(F.col("n") >= TRUST[enough], enough).when(F.col("n") >= TRUST[some], some).otherwise(few)
    return out.withColumn("trust", trust).orderBy(F.array_position(F.array(*map(F.lit, TRUST)), F.col("trust")), *order)


def compare(a: DataFrame, b: DataFrame, key: str = "feature", value: str = "share") -> DataFrame:
    """key, first, second and gap of two tables of contributions; what one lacks counts 0."""
    left, right = a.select(key, F.col(value).alias("first")), b.select(key, F.col(value).alias("second"))
    return left.join(right, key, "full_outer").fillna(0.0, ["first", "second"]).withColumn("gap", F.col("second") - F.col("first"))


def _moments(weight: Column, columns: list[str], target: str) -> list[Column]:
    names = [*columns, target]
    return [F.sum(weight).alias("w"), *(F.sum(weight * F.col(c)).alias(f"s{i}") for i, c in enumerate(names)), *(F.sum(weight * F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in combinations_with_replacement(range(len(names)), 2))]


def _weights(m: dict, k: int, alpha: float) -> np.ndarray:
    """Ridge on standardised columns from sums of products; negative weights are 0, the rest sum to 1."""
    mean = np.array([m[f"s{i}"] for i in range(k + 1)]) / m["w"]
    cov = np.array([[m[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) / m["w"] - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))[:k]
    x = cov[:k, :k] / np.outer(sd, sd) * m["w"]
    w = np.maximum(np.linalg.solve(x + alpha * np.eye(k), cov[:k, k] / sd * m["w"]), 0)
    return w / w.sum() if w.sum() else w


def score_weights(df: DataFrame, columns: list[str], target: str, alpha: float = 1.0, within: str | None = None) -> dict[str, float]:
    """Weights of scores for a target, by ridge regression; only sums of products reach the driver. Without a positive weight all are equal, without rows 0.

    ``within``: a column (a ward) whose exact median target is taken off each row's first, so that the scores do not stand for the place; rows without it are a group.
    """
    rows = df.dropna(subset=[*columns, target])
    if within:
        rows = beside_group(rows, exact_quantiles(rows, [within], target, {"_typical": 0.5}).drop("n"), [within]).withColumn(target, F.col(target) - F.col("_typical"))
    row = rows.agg(*_moments(F.lit(1.0), columns, target)).first().asDict()
    if not row["w"]:
        return dict.fromkeys(columns, 0.0)
    found = _weights(row, len(columns), alpha)
    return dict(zip(columns, map(float, found))) if found.sum() > 0 else dict.fromkeys(columns, 1 / len(columns))


def bootstrap_weights(df: DataFrame, columns: list[str], target: str, row_id: str = "row_id", times: int = 100, alpha: float = 1.0) -> dict[str, dict[str, float]]:
    """Per column the mean weight, its 2.5 and 97.5 percentiles, the share of resamples where it is 0, and measurable: whether the lower one is above 0.

    A row is in each resample as often as a Poisson draw of mean 1 says, seeded by its id; every task multiplies its draws by its rows' products, so no row is repeated, and ``times`` rows of sums a task
    are added up.
    """
    names = [*columns, target]
    products = [(i, j) for i, j in combinations_with_replacement(range(len(names)), 2)]
    labels = ["w", *(f"s{i}" for i in range(len(names))), *(f"p{i}_{j}" for i, j in products)]
    edges = np.cumsum([np.exp(-1.0) / math.factorial(i) for i in range(12)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((times, len(labels)))
        for batch in batches:
            seeds = batch.column(0).to_numpy().view(np.uint64)
            v = np.column_stack([np.asarray(c, float) for c in batch.columns[1:]])
            z = np.column_stack([np.ones(len(v)), v, *(v[:, i] * v[:, j] for i, j in products)])
            with np.errstate(over="ignore"):
                h = (seeds[:, None] + np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            u = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(float) / (1 << 53)
            total += np.searchsorted(edges, u, "right").T.astype(float) @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(times), pa.int32()), *map(pa.array, total.T)], names=["take", *labels])

    slim = df.dropna(subset=names).select(F.xxhash64(row_id).alias("h"), *(F.col(c).cast("double").alias(c) for c in names))
    sums = slim.mapInArrow(run, ", ".join(["take int", *(f"{x} double" for x in labels)])).groupBy("take").agg(*(F.sum(x).alias(x) for x in labels)).where("w > 0").collect()
    found = np.array([_weights(r.asDict(), len(columns), alpha) for r in sums if r["w"]]).reshape(-1, len(columns))
    if not len(found):
        return {}
    low, high = np.percentile(found, 2.5, axis=0), np.percentile(found, 97.5, axis=0)
    return {c: {"mean": float(found[:, i].mean()), "low": float(low[i]), "high": float(high[i]), "zero": float((found[:, i] == 0).mean()), "measurable": bool(low[i] > 0)} for i, c in enumerate(columns)}
