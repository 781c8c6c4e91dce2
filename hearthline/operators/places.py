"""Places of listings put together: batches of one site, new wards with their provenance, names that can be chosen, listings around a point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.geo import in_box
from hearthline.functions.text import district_key, project_key, street_key, ward_key, wrong_level
from hearthline.operators.areas import nearest_centre, within
from hearthline.operators.quality import prefer_first
from hearthline.operators.quantiles import with_stray

#: Where a row's new ward comes from.
GIVEN, TABLE, NEAREST, UNKNOWN = "given", "table", "nearest", "unknown"


def load_batches(batches: list[DataFrame], box: tuple[float, float, float, float], row_id: str = "row_id", most_km: float = 5.0, least: int = 5) -> DataFrame:
    """Batches of one site as a table of known places, with keys of their names (district_key, ward_key, street_key, project_key, new_ward_key).

    Columns that a batch lacks are null. Of a repeated listing_id the row of the earliest batch stays (in it that of the smallest row_id), rows without one all stay. Rows without coordinates or
    outside the box (south, north, west, east) go, then those further than ``most_km`` from the typical place of their ward in their district, where ``least`` or more rows have both.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)])
    once = prefer_first(rows.withColumn("_order", F.struct("_batch", row_id)), "listing_id", F.lit(True), "_order").drop("_order", "_batch")
    rows = once.where("lat IS NOT NULL AND lon IS NOT NULL").where(in_box(F.col("lat"), F.col("lon"), box))
    keys = {"district_key": district_key(F.col("district")), "ward_key": ward_key(F.col("ward")), "street_key": street_key(F.col("street")), "project_key": project_key(F.col("project")), "new_ward_key": ward_key(F.col("new_ward"))}
    both = F.when(F.col("ward_key").isNotNull() & F.col("district_key").isNotNull(), F.struct("ward_key", "district_key"))
    rows = rows.select("*", *(c.alias(n) for n, c in keys.items())).withColumn("_group", F.to_json(both))
    placed = with_stray(rows.where("_group IS NOT NULL"), "_group", "_stray", most_km, least).where(~F.col("_stray")).drop("_stray")
    return placed.unionByName(rows.where("_group IS NULL")).drop("_group")


def with_new_ward(df: DataFrame, table: DataFrame, centres: DataFrame, row_id: str = "row_id") -> DataFrame:
    """df with new_ward, new_ward_from and new_ward_km: its own one if the table knows it (given), else that of its old district and ward (table), else the one of the nearest centre (nearest, with its distance), else none (unknown).

    df: row_id (unique), district, ward, new_ward, lat, lon. A rural ward said to be in an urban district is a street taken for a ward, and becomes null. ``table``: district, ward, new_ward; of several new wards of
    one old name the first by name counts. ``centres``: centre, lat, lon. A row without names and coordinates is unknown.
    """
    known = table.where("new_ward IS NOT NULL").select("new_ward").distinct().withColumn("_known", F.lit(True))
    lookup = table.select(district_key(F.col("district")).alias("_dk"), ward_key(F.col("ward")).alias("_wk"), "new_ward").dropna().groupBy("_dk", "_wk").agg(F.min("new_ward").alias("_table"))
    rows = df.withColumn("ward", F.when(~wrong_level(F.col("district"), F.col("ward")), F.col("ward"))).withColumn("_dk", district_key(F.col("district"))).withColumn("_wk", ward_key(F.col("ward")))
    rows = rows.join(known, "new_ward", "left").join(lookup, ["_dk", "_wk"], "left").withColumn("_given", F.when(F.col("_known"), F.col("new_ward")))
    open_ = rows.where("_given IS NULL AND _table IS NULL").select(row_id, "lat", "lon")
    near = nearest_centre(open_, centres, row_id).select(row_id, F.col("centre").alias("_near"), F.round("km", 2).alias("new_ward_km"))
    out = rows.join(near, row_id, "left").withColumn("new_ward", F.coalesce("_given", "_table", "_near"))
    source = F.when(F.col("_given").isNotNull(), GIVEN).when(F.col("_table").isNotNull(), TABLE).when(F.col("_near").isNotNull(), NEAREST).otherwise(UNKNOWN)
    return out.withColumn("new_ward_from", source).select(*df.columns, "new_ward_from", "new_ward_km")


def main_districts(df: DataFrame) -> DataFrame:
    """ward and the district that most of its listings are in (of equals the first by name), so that a ward across a border is listed once."""
    votes = df.where("ward IS NOT NULL AND district IS NOT NULL").groupBy("ward", "district").count()
    return votes.groupBy("ward").agg(F.min_by("district", F.struct(-F.col("count"), "district")).alias("district"))


def known_names(df: DataFrame, name: str, within_: list[str] | None = None, precise: Column | None = None, least: int = 3) -> DataFrame:
    """within_, name and n: the names (projects, or streets of a ward) whose place is known from ``least`` or more rows with coordinates of their own (``precise``, all if not given)."""
    keys = [*(within_ or []), name]
    rows = df.where("lat IS NOT NULL AND lon IS NOT NULL").dropna(subset=keys)
    return (rows if precise is None else rows.where(precise)).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def choices(df: DataFrame, precise: Column | None = None, least: int = 3, unknown: str = "unknown") -> DataFrame:
    """ward, district, projects, streets: what can be chosen, level by level. A ward stands under its main district, its projects (but for ``unknown``) are those of all its listings, and its streets those with a known place; names are sorted."""
    wards = main_districts(df)
    named = lambda rows, c: rows.groupBy("ward").agg(F.sort_array(F.collect_set(c)).alias(f"{c}s"))
    projects = named(df.where(F.col("project").isNotNull() & (F.col("project") != unknown)).select("ward", "project").dropna().distinct(), "project")
    streets = named(known_names(df, "street", ["ward"], precise, least), "street")
    none = F.array().cast("array<string>")
    out = wards.join(projects, "ward", "left").join(streets, "ward", "left")
    return out.select("ward", "district", F.coalesce("projects", none).alias("projects"), F.coalesce("streets", none).alias("streets"))


#: What a result around a point can be ordered by, all ascending.
AROUND = {"distance": "km", "price": "price", "ppm2": "ppm2"}


def around(df: DataFrame, lat: float, lon: float, km: float, by: str = "distance", most_price: float | None = None, least_area: float | None = None, levels: list[str] | None = None, row_id: str = "row_id") -> DataFrame:
    """Listings within km of a point, with km, by distance, price or price per area (another word: by distance), unknown ones last, then by row_id. ``levels``: only coordinates of these levels, such as those of a street or better."""
    rows = df
    if levels is not None:
        rows = rows.where(F.col("level").isin(levels))
    if most_price is not None:
        rows = rows.where(F.col("price") <= most_price)
    if least_area is not None:
        rows = rows.where(F.col("area") >= least_area)
    return within(rows, lat, lon, km).orderBy(F.col(AROUND.get(by, "km")).asc_nulls_last(), row_id)


def without_place(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """row_id and those of the columns that df has, of the rows to be fetched again: without coordinates, or all if df has no such columns."""
    kept = [c for c in columns if c in df.columns]
    rows = df.where("lat IS NULL OR lon IS NULL") if {"lat", "lon"} <= set(df.columns) else df
    return rows.select(row_id, *kept)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def provenance(df: DataFrame, source: str = "new_ward_from") -> DataFrame:
    """source, n and share of all rows."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    return counts.withColumn("share", _share(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))  # a row per source
