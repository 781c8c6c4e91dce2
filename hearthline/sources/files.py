"""Reading and writing listings: checked schemas, projections of JSON, dumps of polygons, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_listings(spark: SparkSession, path: str, schema: str, required: list[str], kind: str = "csv") -> DataFrame:
    """CSV (with a header), JSON lines or Parquet under one schema; columns of the schema that the file lacks are null."""
    reader = spark.read.schema(schema)
    df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if kind == "csv" else reader.format(kind).load(path)
    return require(df, required)


def project_json(payload: Column, fields: dict[str, str]) -> list[Column]:
    """A typed column for each field of a JSON text; a broken text gives nulls."""
    parsed = F.from_json(payload, ", ".join(f"`{n}` {t}" for n, t in fields.items()))
    return [parsed[n].alias(n) for n in fields]


def epoch(c: Column, per_second: int = 1) -> Column:
    """The time (without a zone, in UTC) of seconds, or of parts of them, since 1970; null for none."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(c.cast("decimal(18,0)") / per_second).cast("decimal(18,6)"))


def export_table(ads: DataFrame, fields: dict[str, str], address: str, row_id: str = "list_id", payload: str = "payload", kind: str | None = None, posted: str = "list_time") -> DataFrame:
    """Stored ads as a flat table: row_id, the fields of the JSON in their types, kind, first_seen and last_seen (from seconds), times, posted (from the JSON's milliseconds; null for 0) and url (``address`` with the id in place of {}).

    ``kind``: only ads of this kind, which reaches the scan. A broken JSON leaves nulls; the JSON is parsed once for all fields.
    """
    wanted = fields if posted in fields else {**fields, posted: "bigint"}
    rows = ads if kind is None else ads.where(F.col("kind") == kind)
    rows = rows.withColumn("_p", F.from_json(payload, ", ".join(f"`{n}` {t}" for n, t in wanted.items())))
    before, after = address.split("{}")
    own = [F.col("_p")[n].alias(n) for n in fields]
    at = F.nullif(F.col("_p")[posted].cast("bigint"), F.lit(0).cast("bigint"))
    return rows.select(row_id, *own, "kind", epoch(F.col("first_seen")).alias("first_seen"), epoch(F.col("last_seen")).alias("last_seen"), "times", epoch(at, 1000).alias("posted"), F.concat(F.lit(before), F.col(row_id).cast("string"), F.lit(after)).alias("url"))


def clean_cell(c: Column, most: int = 32_767) -> Column:
    """Without control characters, at most as long as a spreadsheet's cell."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), 1, most)


def polygon_rings(wkt: Column) -> Column:
    """The rings, as arrays of structs (x, y), of a WKT POLYGON: the outer one, then the holes."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([-0-9. ,eE+]+)\)"), F.lit(1))
    point = lambda p: F.struct(F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("x"), F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double").alias("y"))
    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))


def polygons(wkt: Column) -> Column:
    """The polygons, as arrays of rings, of a WKT POLYGON or MULTIPOLYGON."""
    parts = F.split(F.regexp_replace(wkt, r"\)\s*\)\s*,\s*\(\s*\(", ")|("), r"\|")
    return F.transform(parts, polygon_rings)


def read_polygon_dump(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """code, name and polygons from a text dump of SQL inserts (code, name, WKT), one tuple a line; polygons whose first point is outside the box (south, north, west, east) go before their WKT is read."""
    line = r"\(\s*'?([^',]+)'?\s*,\s*'([^']*)'\s*,\s*'((?:MULTI)?POLYGON[^']*)'"
    rows = spark.read.text(path).where(F.col("value").rlike(line)).select(*(F.regexp_extract("value", line, i).alias(n) for i, n in ((1, "code"), (2, "name"), (3, "wkt"))))
    first = r"\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)"
    x, y = (F.regexp_extract("wkt", first, i).cast("double") for i in (1, 2))
    return rows.where(y.between(box[0], box[1]) & x.between(box[2], box[3])).dropDuplicates(["code"]).select("code", "name", polygons(F.col("wkt")).alias("polygons"))


def geojson(rings: Column, **properties: Column) -> Column:
    """A GeoJSON feature of a polygon as text."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*(c.alias(n) for n, c in properties.items())).alias("properties")))


def cell_ring(cx: Column, cy: Column, size: Column) -> Column:
    """The closed ring of a grid cell."""
    corners = ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    return F.array(*(F.struct(((cx + i) * size).alias("x"), ((cy + j) * size).alias("y")) for i, j in corners))


def with_cache(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests with what is cached for them, a cached failure (null values) too; and the distinct keys that are not cached."""
    hit = cache.withColumn("cached", F.lit(True))
    joined = requests.join(hit, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return joined, requests.select(key).distinct().join(cache.select(key), key, "left_anti")
