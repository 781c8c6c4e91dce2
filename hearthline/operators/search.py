"""Searching a catalogue by ordered, self-relaxing conditions, and ranking what is found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Condition:
    """A named predicate. A null result counts as ``unknown``: rows that lack the value pass exclusions and fail demands."""

    name: str
    test: Column
    unknown: bool = False

    def holds(self) -> Column:
        return F.coalesce(self.test, F.lit(self.unknown))


def relax(df: DataFrame, conditions: list[Condition], at_once: int = 12) -> tuple[DataFrame, list[str]]:
    """Rows that meet the conditions, taken in order and each skipped that would leave none; and the names of those skipped.

    One aggregate finds which of the next ``at_once`` conditions the rows left meet together (at most 2 ** at_once groups come back), and the order is folded over these groups.
    """
    skipped, kept = [], F.lit(True)
    for start in range(0, len(conditions), at_once):
        some, mask = conditions[start : start + at_once], F.lit(0).cast("long")
        for i, c in enumerate(some):
            mask = mask + F.when(c.holds(), F.lit(1 << i)).otherwise(F.lit(0))
        left = [r["mask"] for r in df.where(kept).select(mask.alias("mask")).distinct().collect()]
        for i, c in enumerate(some):
            still = [m for m in left if m >> i & 1]
            if still:
                left, kept = still, kept & c.holds()
            else:
                skipped.append(c.name)
    return df.where(kept), skipped


def match_score(price: Column, area: Column, ceiling: float | None, floor: float | None, area_floor: float | None, area_ceiling: float | None) -> Column:
    """Relative distance to the price named (the ceiling, else the floor) and to the area named (the floor, else the ceiling); null if a value is missing."""
    parts = [(price, next((v for v in (ceiling, floor) if v), None)), (area, next((v for v in (area_floor, area_ceiling) if v), None))]
    out = F.lit(0.0)
    for column, anchor in parts:
        if anchor:
            out = out + F.abs(column - anchor) / anchor
    return out


def ranked(df: DataFrame, score: Column, seen: str = "seen", row_id: str = "row_id") -> DataFrame:
    """By score, unknown ones last, then the newest first, then row_id."""
    return df.orderBy(score.asc_nulls_last(), F.col(seen).desc_nulls_last(), row_id)


#: Orders of results: the best match, the cheapest, the furthest below and above the estimate.
BEST, CHEAPEST, BELOW, ABOVE = "best", "cheapest", "below", "above"


def arranged(df: DataFrame, how: str, request: dict, deviation: str = "deviation", seen: str = "seen", row_id: str = "row_id") -> DataFrame:
    """Results in one of the orders, unknown values last, then the newest first, then row_id. Without the column of deviations (and for another word) it is the best match, by the prices and areas that the request names."""
    key = match_score(F.col("price"), F.col("area"), *(request.get(k) for k in ("price_to", "price_from", "area_from", "area_to"))).asc_nulls_last()
    if how == CHEAPEST:
        key = F.col("price").asc_nulls_last()
    elif how in (BELOW, ABOVE) and deviation in df.columns:
        key = F.col(deviation).asc_nulls_last() if how == BELOW else F.col(deviation).desc_nulls_last()
    return df.orderBy(key, F.col(seen).desc_nulls_last(), row_id)


def comparables(df: DataFrame, ward: str, district: str, area: float, rooms: int, k: int = 10, row_id: str = "row_id") -> DataFrame:
    """The k listings most alike: of the ward if it has k, else of the district; by relative gap in area, then gap in rooms (9 if unknown). Price plays no part."""
    inside = df.where((F.col("ward") == ward) | (F.col("district") == district))
    enough = inside.agg((F.count_if(F.col("ward") == ward) >= k).alias("enough"))
    scoped = inside.join(F.broadcast(enough)).where(F.when(F.col("enough"), F.col("ward") == ward).otherwise(F.col("district") == district)).drop("enough")
    gap = scoped.withColumn("area_gap", F.abs(F.col("area") - area) / area).withColumn("room_gap", F.coalesce(F.abs(F.col("rooms") - rooms), F.lit(9)))
    return gap.orderBy("area_gap", "room_gap", row_id).limit(k)


def price_hint(df: DataFrame, ceiling: float, least: int = 5) -> DataFrame:
    """n, lowest, q25 and median of the prices if there are ``least`` or more and all lie above the ceiling; else no row."""
    out = exact_quantiles(df, [], "price", {"lowest": 0.0, "q25": 0.25, "median": 0.5})
    return out.where((F.col("n") >= least) & (F.col("lowest") > ceiling))


def coverage_notes(df: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    """column and the share of rows that have it, for columns below ``least``."""
    shares = df.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns))).alias("x")).select("x.*").where(F.col("share") < least)


def budget(df: DataFrame, money: float, needs: Column) -> DataFrame:
    """Per ward: listings, those that fit the needs, those of them within the money, their share, and the medians of price and area of the fitting ones."""
    fits = F.coalesce(needs, F.lit(False))
    within = fits & (F.col("price") <= money)
    out = df.where("ward IS NOT NULL").groupBy("ward").agg(F.count("*").alias("n"), F.count_if(fits).alias("fitting"), F.count_if(within).alias("affordable"), F.median(F.when(fits, F.col("price"))).alias("median_price"), F.median(F.when(fits, F.col("area"))).alias("median_area"))
    return out.where("fitting > 0").withColumn("share", F.col("affordable") / F.col("fitting"))


#: The order in which a request's conditions are tried: the place first, details last. Must-haves and must-nots follow.
EQUAL, LEAST, MOST, AMONG = "equal", "least", "most", "among"
ORDER = [
    ("project", EQUAL, "project"), ("street", EQUAL, "street"), ("ward", EQUAL, "ward"), ("district", EQUAL, "district"), ("kind", EQUAL, "kind"), ("not_kinds", "none of", "kind"),
    ("price_from", LEAST, "price"), ("price_to", MOST, "price"), ("ppm2_from", LEAST, "ppm2"), ("ppm2_to", MOST, "ppm2"), ("area_from", LEAST, "area"), ("area_to", MOST, "area"),
    ("rooms", EQUAL, "rooms"), ("baths", EQUAL, "baths"), ("floor", "between", "floor"), ("frontage_from", LEAST, "frontage"), ("road_from", LEAST, "road"), ("centre_to", MOST, "centre_km"),
    ("papers", AMONG, "papers"), ("facing", AMONG, ("door_facing", "balcony_facing")), ("door_facing", AMONG, "door_facing"), ("balcony_facing", AMONG, "balcony_facing"),
    ("not_facing", "none of", ("door_facing", "balcony_facing")), ("furniture", AMONG, "furniture"),
]


def conditions(request: dict, columns: list[str]) -> tuple[list[Condition], list[str]]:
    """The conditions of a request in ORDER, then its must-haves (``with``) and must-nots (``without``), names of 0/1 columns; and the names of those whose column is missing.

    A facing is that of the door or of the balcony where both are known columns. A missing value fails a demand and passes an exclusion; flags that are no column are passed over.
    """
    out, missing = [], []
    for name, how, where in ORDER:
        if name not in request:
            continue
        v, there = request[name], [F.col(c) for c in ([where] if isinstance(where, str) else where) if c in columns]
        if not there and how != "none of":
            missing.append(name)
            continue
        if how == "between":
            low, high = v
            tests = [F.coalesce(c >= low if low else c.isNotNull(), F.lit(False)) & (c <= high if high else F.lit(True)) for c in there]
        else:
            tests = [{EQUAL: lambda c: c == v, LEAST: lambda c: c >= v, MOST: lambda c: c <= v}.get(how, lambda c: c.isin(list(v)))(c) for c in there]  # noqa: B023
        any_ = F.lit(False)
        for t in tests:
            any_ = any_ | F.coalesce(t, F.lit(False))
        out.append(Condition(name, ~any_ if how == "none of" else any_))
    for key, wanted in (("with", True), ("without", False)):
        for c in request.get(key, []):
            if c in columns:
                has = F.coalesce(F.col(c) > 0, F.lit(False))
                out.append(Condition(c, has if wanted else ~has))
    return out, missing


def find(df: DataFrame, request: dict) -> tuple[DataFrame, list[str]]:
    """Rows with a price that meet the request, relaxed in order, and the names of the conditions that were skipped: those whose column is missing, and those that would leave none."""
    tried, missing = conditions(request, df.columns)
    rows, skipped = relax(df.where("price IS NOT NULL"), tried)
    return rows, [*missing, *skipped]
