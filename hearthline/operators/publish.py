"""Bundles of rows and a fitted appraiser: written under a new name, checked by pricing everything again from what was written, and only then published by a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.bundles import data_fingerprint, fingerprint
from hearthline.operators.valuation import Appraiser

VERSION = 1
#: Columns that come from a row's own price: no model may read them.
OWN = ("price", "price_per_area", "y", "predicted", "low", "high", "deviation", "position", "fold")
CLOSE = 1e-6


def leaks(inputs: list[str], own: tuple[str, ...] = OWN) -> list[str]:
    """The inputs that are columns of a row's own price."""
    return [c for c in inputs if c.lower() in own]


def _write_text(spark: SparkSession, path: str, value: dict) -> None:
    spark.range(1).select(F.lit(json.dumps(value, sort_keys=True, ensure_ascii=False)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_appraiser(appraiser: Appraiser, path: str) -> None:
    """All parts of an appraiser as tables and one text of numbers."""
    spark = appraiser.train.sparkSession
    for c, table in appraiser.tables.items():
        table.write.mode("overwrite").parquet(f"{path}/encoding/{c}")
    appraiser.train.write.mode("overwrite").parquet(f"{path}/train")
    appraiser.model.write().overwrite().save(f"{path}/model")
    n, offset = appraiser.offset.select("n", "offset").first() or (0, None)
    _write_text(spark, f"{path}/numbers", {"numbers": appraiser.numbers, "categories": appraiser.categories, "medians": appraiser.medians, "overall": appraiser.overall, "n": n, "offset": offset})


def load_appraiser(spark: SparkSession, path: str) -> Appraiser:
    known = _read_text(spark, f"{path}/numbers")
    tables = {c: spark.read.parquet(f"{path}/encoding/{c}") for c in known["categories"]}
    offset = spark.createDataFrame([(known["n"], known["offset"])] if known["n"] else [], "n long, offset double")
    return Appraiser(known["numbers"], known["categories"], known["medians"], known["overall"], tables, GBTRegressionModel.load(f"{path}/model"), offset, spark.read.parquet(f"{path}/train"))


def difference(a: DataFrame, b: DataFrame, row_id: str, columns: list[str]) -> tuple[int, float]:
    """How many rows only one side has, or has a null where the other has a value, and the largest relative difference of the others; one aggregate over a full join. Row ids have to be unique."""
    right = b.select(F.col(row_id).alias("_id"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(1).alias("_there"))
    both = a.select(row_id, *columns, F.lit(1).alias("_here")).join(right, F.col(row_id).eqNullSafe(F.col("_id")), "full")
    odd = F.col("_here").isNull() | F.col("_there").isNull()
    for c in columns:
        odd = odd | (F.col(c).isNull() != F.col(f"_{c}").isNull())
    gap = F.greatest(F.lit(0.0), *(F.abs(F.col(c) - F.col(f"_{c}")) / F.greatest(F.abs(F.col(c)), F.lit(1.0)) for c in columns))
    row = both.agg(F.count_if(odd).alias("odd"), F.coalesce(F.max(F.when(~odd, gap)), F.lit(0.0)).alias("gap")).first()
    return row["odd"], row["gap"]


def _parts(spark: SparkSession, path: str, columns: list[str]) -> dict[str, str]:
    """A fingerprint of every table of a bundle."""
    names = _read_text(spark, f"{path}/appraiser/numbers")["categories"]
    out = {f"encoding/{c}": data_fingerprint(t := spark.read.parquet(f"{path}/appraiser/encoding/{c}"), t.columns) for c in names}
    return out | {"rows": data_fingerprint(spark.read.parquet(f"{path}/rows"), columns)}


def _manifests(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the manifests that were committed, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def publish(root: str, rows: DataFrame, appraiser: Appraiser, config: dict, row_id: str = "row_id", own: tuple[str, ...] = OWN) -> str:
    """Write rows and appraiser as a bundle under root, check it, publish it, and give its folder.

    Refused with ValueError, before anything is published: an appraiser that reads columns of a row's own price; a bundle that, loaded again, prices any of the rows as they are, or as they were
    written, otherwise than the appraiser does (by more than CLOSE, a null against a value, a row too many or too few); row ids that repeat. The manifest is the commit: a run that ends before it leaves a folder that nobody reads, and the
    earlier bundle stays in use. It holds fingerprints of all tables, so that serve() sees a part that was lost or changed.
    """
    spark = rows.sparkSession
    if bad := leaks(appraiser.inputs, own):
        raise ValueError(f"the model would learn prices from themselves: {', '.join(bad)}")
    if rows.groupBy(row_id).count().where("count > 1").limit(1).count():
        raise ValueError(f"{row_id} repeats")
    path, columns = f"{root}/bundles/{uuid.uuid4().hex}", rows.columns
    rows.write.parquet(f"{path}/rows")
    save_appraiser(appraiser, f"{path}/appraiser")
    again, written = load_appraiser(spark, f"{path}/appraiser"), spark.read.parquet(f"{path}/rows")
    names = ["predicted", "low", "high"]
    price = lambda who, df: who.price(df.drop(*names)).select(row_id, *names)
    first = price(appraiser, rows)
    for what, other in (("the model loaded again", price(again, rows)), ("the rows read again", price(again, written))):
        odd, gap = difference(first, other, row_id, names)
        if odd or not gap < CLOSE:
            raise ValueError(f"{what} gives other prices: {odd} rows differ, the others by up to {gap:.2e}")
    manifest = {"version": VERSION, "bundle": path, "config": fingerprint(config), "columns": columns, "parts": _parts(spark, path, columns)}
    taken = _manifests(spark, root)
    _write_text(spark, f"{root}/manifests/{taken[-1] + 1 if taken else 1}", manifest)
    return path


def serve(spark: SparkSession, root: str, config: dict) -> tuple[Appraiser | None, DataFrame | None, list[str]]:
    """The newest published bundle that is whole and of this configuration: its appraiser and rows, and why newer ones were passed over; None twice if none is."""
    reasons = []
    for number in reversed(_manifests(spark, root)):
        try:
            manifest = _read_text(spark, f"{root}/manifests/{number}")
            if manifest["version"] != VERSION:
                raise ValueError(f"version {manifest['version']}, not {VERSION}")
            if manifest["config"] != fingerprint(config):
                raise ValueError("another configuration")
            found = _parts(spark, manifest["bundle"], manifest["columns"])
            if changed := [k for k, v in manifest["parts"].items() if found.get(k) != v]:
                raise ValueError(f"changed: {', '.join(changed)}")
            appraiser = load_appraiser(spark, f"{manifest['bundle']}/appraiser")
            appraiser.train.limit(1).count()
            return appraiser, spark.read.parquet(f"{manifest['bundle']}/rows"), reasons
        except Exception as e:  # whatever a broken part raises: the earlier bundle goes on
            reasons.append(f"{number}: {type(e).__name__}: {str(e).splitlines()[0][:200]}")
    return None, None, reasons
