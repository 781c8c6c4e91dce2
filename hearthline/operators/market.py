"""Batches into one clean table, and what is served from it: merges, gates, reports, places of a request, deals, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.functions.geo import haversine_km, in_box
from hearthline.functions.text import fold, ward_key
from hearthline.operators.areas import contains
from hearthline.operators.lineage import cut_lineage
from hearthline.operators.quantiles import column_quantiles, exact_quantiles, median_places
from hearthline.operators.quality import keep_first, similar_leaders

#: Positional error in kilometres that smoothing starts from, and where none is known.
LEAST_SIGMA, USUAL_SIGMA = 0.30, 0.70
#: The place that a site fills in where none was pinned (and how near to it counts), and the levels a place is looked up by after the row's own and the listing's id, the surest first.
FILLED_IN, FILLED_IN_KM = (21.02895, 105.85245), 0.03
LEVELS = [
    ("project", ["project"]), ("street", ["district", "ward", "street"]), ("ward", ["district", "ward"]), ("new ward street", ["district", "new_ward", "street"]),
    ("new ward", ["district", "new_ward"]), ("district street", ["district", "street"]), ("district", ["district"]),
]


def fill_unit_price(df: DataFrame, price: str = "price", area: str = "area", unit: str = "ppm2") -> DataFrame:
    """unit as stated, else price / area; null where the area is missing or 0."""
    made = F.col(price) / F.nullif(F.col(area), F.lit(0.0))
    return df.withColumn(unit, F.coalesce(F.col(unit), made) if unit in df.columns else made)


def parser_gate(error: Column, df: DataFrame, off: float = 0.01, most: float = 0.01) -> DataFrame:
    """rows, compared (an error is known), off (it is above ``off``) and ok: no more than ``most`` of all rows are."""
    out = df.agg(F.count("*").alias("rows"), F.count(error).alias("compared"), F.count_if(error > off).alias("off"))
    return out.withColumn("ok", F.col("off") <= most * F.col("rows"))


def require_gate(gate: DataFrame) -> None:
    """A ValueError if the gate's row is not ok."""
    row = gate.first()
    if not row["ok"]:
        raise ValueError(f"{row['off']} of {row['rows']} rows are off")


def within_limits(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Values above their column's limit become null."""
    return df.withColumns({c: F.when(~F.coalesce(F.col(c) > most, F.lit(False)), F.col(c)) for c, most in limits.items()})


def limit_report(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """column and how many values are above its limit."""
    counts = df.agg(*(F.count_if(F.col(c) > most).alias(c) for c, most in limits.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("above")) for c in limits))).alias("x")).select("x.*")


def label_losses(df: DataFrame, raw: str, clean: str, most: float = 0.2, top: int = 3) -> DataFrame:
    """known (raw values), lost (their clean label is null), share, alarm (share above ``most``) and the ``top`` values most often lost, by count and then name."""
    lost = df.where(F.col(raw).isNotNull() & F.col(clean).isNull()).groupBy(raw).agg(F.count("*").alias("n")).orderBy(F.desc("n"), raw).limit(top)
    names = lost.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(raw).alias("v")))).alias("v")).select(F.transform("v", lambda x: x["v"]).alias("most_lost"))
    counts = df.agg(F.count(raw).alias("known"), F.count_if(F.col(raw).isNotNull() & F.col(clean).isNull()).alias("lost"))
    return counts.withColumn("share", F.coalesce(F.col("lost") / F.nullif(F.col("known"), F.lit(0)), F.lit(0.0))).withColumn("alarm", F.col("share") > most).join(F.broadcast(names))


def title_agreement(df: DataFrame, price: Column, named: Column, tolerance: float = 0.15) -> DataFrame:
    """compared (both known) and share: how many titles name the price within the tolerance."""
    near = F.abs(named - price) / price <= tolerance
    return df.agg(F.count(near).alias("compared"), F.coalesce(F.avg(near.cast("double")), F.lit(0.0)).alias("share"))


def missing_places(df: DataFrame, most: float = 0.1) -> DataFrame:
    """rows, missing (no coordinates), share and alarm (share above ``most``)."""
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    out = df.agg(F.count("*").alias("rows"), F.count_if(missing).alias("missing"))
    return out.withColumn("share", F.coalesce(F.col("missing") / F.nullif(F.col("rows"), F.lit(0)), F.lit(0.0))).withColumn("alarm", F.col("share") > most)


def attach_by_id(df: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """df with the columns of table for its key: the first row of each key by ``order``; a null key gets nothing."""
    once = keep_first(table.where(F.col(key).isNotNull()), [key], order).drop(order)
    return df.join(once, key, "left")


def merge_batches(batches: DataFrame, listing_id: str, business: Column, text: str, block: list[str], row_id: str = "row_id", cut: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The rows left when, in turn, all but the first of a listing id (where there is one), of a business key (where there is one), and of near-equal texts in a block are dropped; and a ledger: step, place, kept, removed, percent of all rows."""

    def first(df: DataFrame, key: Column) -> DataFrame:
        """The first row of each key; rows without one stay, and are in no window."""
        keyed = df.withColumn("_key", key)
        once = keyed.where("_key IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(row_id))).where("_r = 1").drop("_r")
        return once.unionByName(keyed.where("_key IS NULL")).drop("_key")

    by_id = first(batches, F.col(listing_id))
    by_key = first(by_id, business)
    leaders = similar_leaders(by_key, block, text, row_id, cut).where(F.col(row_id) == F.col("leader")).select(row_id)
    out = by_key.join(leaders, row_id, "left_semi")
    steps = [("all", batches), ("listing id", by_id), ("business key", by_key), ("near texts", out)]
    counts = reduce(lambda a, b: a.unionByName(b), (d.agg(F.lit(name).alias("step"), F.lit(i).alias("place"), F.count("*").alias("kept")) for i, (name, d) in enumerate(steps)))
    w = Window.orderBy("place")  # four rows
    ledger = counts.withColumn("removed", F.coalesce(F.lag("kept").over(w) - F.col("kept"), F.lit(0))).withColumn("percent", F.round(100 * F.col("removed") / F.first("kept").over(w), 2))
    return out, ledger


def weighted_centre(df: DataFrame, key: str, weight: str) -> DataFrame:
    """key, lat and lon: the mean of places weighted by counts; places without coordinates or a positive weight take no part."""
    known = df.where((F.col(weight) > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    mean = lambda c: (F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(c)
    return known.groupBy(key).agg(mean("lat"), mean("lon"), F.sum(weight).alias("weight"))


def smoothing_width(df: DataFrame, error: str) -> DataFrame:
    """sigma: the mean positional error, not below LEAST_SIGMA; USUAL_SIGMA if none is known."""
    return df.agg(F.greatest(F.coalesce(F.avg(error), F.lit(USUAL_SIGMA)), F.lit(LEAST_SIGMA)).alias("sigma"))


def colour_range(df: DataFrame, value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """low and high: the quantiles that a colour scale runs between."""
    return exact_quantiles(df, [], value, {"low": low, "high": high}).select("low", "high")


def finest_cell(points: DataFrame, grid: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Points (x, y in kilometres) with the smallest cell (size, cx, cy, ...) of a grid of several sizes that holds them; those in none are left out. An equi-join per size."""
    sizes = grid.select("size").distinct()  # one row per level
    at = points.join(F.broadcast(sizes)).withColumn("cx", F.floor(F.col("x") / F.col("size"))).withColumn("cy", F.floor(F.col("y") / F.col("size")))
    found = at.join(grid, ["size", "cx", "cy"])
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(row_id).orderBy("size"))).where("_r = 1").drop("_r")


def level_report(df: DataFrame, level: str = "level") -> DataFrame:
    """level, n and percent of all rows."""
    all_ = df.agg(F.count("*").alias("_all"))
    return df.groupBy(level).agg(F.count("*").alias("n")).join(F.broadcast(all_)).withColumn("percent", F.round(100 * F.col("n") / F.col("_all"), 2)).drop("_all")


def place_table(df: DataFrame, keys: list[str], precise: Column | None = None, least: int = 3) -> DataFrame:
    """keys, lat, lon and n: the median place of rows with coordinates (of those that are ``precise``), for keys of ``least`` rows or more; a null key has none."""
    return median_places(df.where(precise) if precise is not None else df, [keys])[0].where(F.col("n") >= least)


def complete_places(requests: DataFrame, known: DataFrame, levels: list[tuple[str, list[str]]], least: int = 3) -> DataFrame:
    """Requests with lat, lon and level: their own pin, else the place of the first level whose keys ``known`` has ``least`` rows of."""
    out = requests.withColumn("_pin", F.col("lat").isNotNull() & F.col("lon").isNotNull())
    tables = median_places(known, [keys for _, keys in levels])
    for i, ((_, keys), table) in enumerate(zip(levels, tables)):
        out = out.join(table.where(F.col("n") >= least).select(*keys, F.col("lat").alias(f"_lat{i}"), F.col("lon").alias(f"_lon{i}")), keys, "left")
    pick = lambda own, cols: F.coalesce(F.when(F.col("_pin"), own), *cols)
    n = range(len(levels))
    out = out.withColumn("level", pick(F.lit("pin"), [F.when(F.col(f"_lat{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(levels)]))
    out = out.withColumn("lat", pick(F.col("lat"), [F.col(f"_lat{i}") for i in n])).withColumn("lon", pick(F.col("lon"), [F.col(f"_lon{i}") for i in n]))
    return out.drop("_pin", *(f"_{c}{i}" for i in n for c in ("lat", "lon")))


def assign_places(df: DataFrame, reference: DataFrame, levels: list[tuple[str, list[str]]] = LEVELS, listing_id: str | None = None, errors: dict[str, float] | None = None) -> DataFrame:
    """Rows with lat, lon, level, support and error_km: their own place ('own') unless outside the area or filled in by the site, else that of the reference row with their listing id ('id'),
    else the median place of the reference rows that share the first level's keys, and so on; null if no level has any. A null key matches nothing; of several rows of an id the smallest place counts.
    ``support`` is how many reference rows stand behind a place (null for own ones), ``error_km`` what ``errors`` says of the level (null if nothing).
    """
    known = reference.where("lat IS NOT NULL AND lon IS NOT NULL")
    own = in_box(F.col("lat"), F.col("lon")) & (haversine_km(F.col("lat"), F.col("lon"), F.lit(FILLED_IN[0]), F.lit(FILLED_IN[1])) >= FILLED_IN_KM)
    steps, out = [], df.withColumn("_own", own)
    if listing_id:
        one = known.where(F.col(listing_id).isNotNull()).groupBy(listing_id).agg(F.min(F.struct("lat", "lon")).alias("_p"))
        steps.append(("id", [listing_id], one.select(listing_id, F.col("_p.lat").alias("la"), F.col("_p.lon").alias("lo"), F.lit(1).cast("long").alias("n"))))
    tables = median_places(known, [keys for _, keys in levels])
    steps += [(name, keys, table.withColumnsRenamed({"lat": "la", "lon": "lo"})) for (name, keys), table in zip(levels, tables)]
    for i, (_, keys, found) in enumerate(steps):
        out = out.join(found.withColumnsRenamed({c: f"_{c}{i}" for c in ("la", "lo", "n")}), keys, "left")
    pick = lambda first, c: F.coalesce(F.when(F.col("_own"), first), *(F.when(~F.col("_own"), F.col(f"_{c}{i}")) for i in range(len(steps))))
    names = F.coalesce(F.when(F.col("_own"), "own"), *(F.when(F.col(f"_n{i}").isNotNull(), F.lit(name)) for i, (name, _, _) in enumerate(steps)))
    out = out.withColumns({"level": names, "support": pick(F.lit(None).cast("long"), "n"), "lat": pick(F.col("lat"), "la"), "lon": pick(F.col("lon"), "lo")})
    said = reduce(lambda c, e: c.when(F.col("level") == e[0], F.lit(float(e[1]))), (errors or {}).items(), F.when(F.lit(False), F.lit(0.0)))
    return out.withColumn("error_km", said).drop("_own", *(f"_{c}{i}" for i in range(len(steps)) for c in ("la", "lo", "n")))


def audit_places(df: DataFrame, reference: DataFrame, listing_id: str, levels: list[tuple[str, list[str]]] = LEVELS) -> DataFrame:
    """level, n, q50, q90 (kilometres) and the shares within 0.5, 1 and 2: how far places looked up without the row's own place and id are from those of its listing id."""
    place = reference.where(F.col(listing_id).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    truth = place.groupBy(listing_id).agg(F.min(F.struct("lat", "lon")).alias("truth"))
    blank = df.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}).join(truth, listing_id)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("truth.lat"), F.col("truth.lon"))
    found = cut_lineage(assign_places(blank, reference, levels).withColumn("km", km).where("level IS NOT NULL").select("level", "km"))
    shares = [F.avg((F.col("km") <= most).cast("double")).alias(name) for most, name in ((0.5, "within_500m"), (1.0, "within_1km"), (2.0, "within_2km"))]
    return found.groupBy("level").agg(F.count("*").alias("n"), *shares).join(exact_quantiles(found, ["level"], "km", {"q50": 0.5, "q90": 0.9}).drop("n"), "level", "left").select("level", "n", "q50", "q90", "within_500m", "within_1km", "within_2km")


def position(df: DataFrame, price: str = "price", predicted: str = "predicted", low: str = "low", high: str = "high") -> DataFrame:
    """Adds deviation (per cent of the predicted price) and position: below, above or inside the interval (an unknown one too)."""
    where = F.when(F.col(price) < F.col(low), "below").when(F.col(price) > F.col(high), "above").otherwise("inside")
    return df.withColumn("deviation", 100 * (F.col(price) / F.col(predicted) - 1)).withColumn("position", where)


def position_counts(df: DataFrame) -> DataFrame:
    """rows, below, above, inside and covered, the share inside."""
    out = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col("position") == p).alias(p) for p in ("below", "above", "inside")))
    return out.withColumn("covered", F.col("inside") / F.nullif(F.col("rows"), F.lit(0)))


def anomalies(df: DataFrame, which: str, k: int = 30, sure: Column | None = None, row_id: str = "row_id") -> DataFrame:
    """The k rows of a position, the widest deviation first, of equals the smaller row_id; with ``sure`` only those whose place is known well."""
    rows = df.where(F.col("position") == which)
    rows = rows.where(sure) if sure is not None else rows
    return rows.orderBy(F.asc("deviation") if which == "below" else F.desc("deviation"), row_id).limit(k)


def affordable(df: DataFrame, money: float, needs: Column, k: int = 50, row_id: str = "row_id") -> DataFrame:
    """The k rows within the money that meet the needs (an unknown need is not met), the cheapest per square metre first."""
    return df.where((F.col("price") <= money) & F.coalesce(needs, F.lit(False))).withColumn("ppm2", F.col("price") / F.col("area")).orderBy(F.asc_nulls_last("ppm2"), row_id).limit(k)


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, q25, q50 and q75 of a result, which the next question starts from."""
    return column_quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")


def unambiguous(df: DataFrame, old: str, new: str) -> DataFrame:
    """old and new of the old names that always have the same new one."""
    return df.where(F.col(old).isNotNull() & F.col(new).isNotNull()).groupBy(old).agg(F.min(new).alias(new), F.count_distinct(new).alias("_n")).where("_n = 1").drop("_n")


def renamed_wards(df: DataFrame, old: str, new: str, least: int = 3) -> DataFrame:
    """key, new and variants: the old ward names, without their kind and folded, and their stems without a number at the end, that lead to one new ward; the longest first.

    A stem counts beside the names themselves: 'X' leads to a ward only if 'X 1', 'X 2' and 'X' all lead there; variants is how many names do. Names of fewer than ``least`` letters and null ones are none.
    """
    named = df.where(F.col(new).isNotNull()).select(ward_key(F.col(old)).alias("name"), F.col(new).alias("new"))
    stem = F.regexp_replace("name", r"\s*\d+$", "")
    keys = named.select("name", "new", F.explode(F.array_distinct(F.array("name", stem))).alias("key")).where(F.length("key") >= least)
    found = keys.groupBy("key").agg(F.min("new").alias("new"), F.max("new").alias("_other"), F.count_distinct("name").alias("variants"))
    return found.where(F.col("new").eqNullSafe(F.col("_other"))).select("key", "new", "variants").orderBy(F.desc(F.length("key")), "key")


def named_polygons(polygons: DataFrame, points: DataFrame, name: str, least: int = 3) -> DataFrame:
    """polygon, name, n and agreement: the most frequent name of the points inside, of equals the first, and its share; polygons with fewer than ``least`` named points get none."""
    votes = contains(points.where(F.col(name).isNotNull()), polygons).groupBy("polygon", name).agg(F.count("*").alias("v"))
    out = votes.groupBy("polygon").agg(F.min(F.struct((-F.col("v")).alias("v"), F.col(name).alias("name"))).alias("best"), F.sum("v").alias("n")).where(F.col("n") >= least)
    return out.select("polygon", F.col("best.name").alias("name"), "n", (-F.col("best.v") / F.col("n")).alias("agreement"))


def find_names(names: DataFrame, name: str, asked: str, k: int = 10) -> DataFrame:
    """name, n and match of the k names that are (0), begin with (1) or hold (2) what is asked for, folded, or the other way round; the better match first, then the more frequent."""
    key, want = fold(name), fold(F.lit(asked))
    match = F.when(key == want, 0).when(key.startswith(want) | want.startswith(key), 1).when(key.contains(want) | want.contains(key), 2)
    found = names.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).withColumn("match", F.when(F.length(key) > 0, match))
    return found.where("match IS NOT NULL").orderBy("match", F.desc("n"), name).limit(k)


#: Up to so many names go to every task; more are joined by a sort of both sides. The runs of words of all texts are never sent to the driver, however few the planner takes them for.
MOST_NAMES = 200_000


def _named_runs(runs: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """runs joined by ``run`` with names (name and run, distinct): the names are the side that is sent to all tasks, and only if they are at most ``most``."""
    names = cut_lineage(names)
    return runs.join(F.broadcast(names) if names.count() <= most else names.hint("merge"), "run")


def names_in_texts(texts: DataFrame, names: DataFrame, row_id: str, text: str, name: str, most_words: int = 4, most_names: int = MOST_NAMES) -> DataFrame:
    """row_id and the names (of up to most_words words) that stand in its text as whole words, folded: an equi-join on runs of words, not a search for each name."""
    def plain(c: str) -> Column:
        return F.filter(F.split(fold(c), r"[^a-z0-9]+"), lambda w: w != "")

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))

    # outer, as for others the optimizer infers a filter in which the words are split anew for every run
    found = texts.select(row_id, plain(text).alias("w")).select(row_id, F.explode_outer(F.array_distinct(F.flatten(F.array(*map(runs, range(1, most_words + 1)))))).alias("run"))
    table = names.select(F.col(name).alias("name"), F.array_join(plain(name), " ").alias("run")).where("run <> ''").distinct()
    return _named_runs(found, table, most_names).select(row_id, "name").distinct()


def name_spans(texts: DataFrame, names: DataFrame, row_id: str, text: str, name: str, most_words: int = 4, most_names: int = MOST_NAMES) -> DataFrame:
    """row_id, name, start and words: every place (in words, from 1) where a name of up to most_words words stands in a text as whole words, folded, unless it lies inside a longer name's place. An equi-join on runs of words; of
    two names that fold alike the first counts; a text's places are compared with one another in its own row."""
    def plain(c: str) -> Column:
        return F.filter(F.split(fold(c), r"[^a-z0-9]+"), lambda w: w != "")

    def runs(n: int) -> Column:
        last = F.size("w") - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(i.alias("start"), F.lit(n).alias("words"), F.array_join(F.slice("w", i, n), " ").alias("run")))).otherwise(F.array())

    found = texts.select(row_id, plain(text).alias("w")).select(row_id, F.inline_outer(F.flatten(F.array(*map(runs, range(1, most_words + 1))))))
    table = names.select(F.col(name).alias("name"), F.array_join(plain(name), " ").alias("run")).where("run <> ''").groupBy("run").agg(F.min("name").alias("name"))
    hits = cut_lineage(_named_runs(found, table, most_names))
    # a longer place that holds this one begins at most most_words - 1 words before it: an equi-join on where it may begin
    longer = hits.select(F.col(row_id).alias("_id"), F.col("start").alias("_start"), F.col("words").alias("_words"))
    ends = F.col("start") + F.col("words")
    begins = hits.select(row_id, "name", "start", "words", F.explode(F.sequence(F.greatest(F.col("start") - most_words + 1, F.lit(1)), F.col("start"))).alias("_at"))
    on = (F.col(row_id) == F.col("_id")) & (F.col("_at") == F.col("_start"))
    inside = begins.join(longer, on).where((F.col("_words") > F.col("words")) & (F.col("_start") + F.col("_words") >= ends)).select(row_id, "start", "words").distinct()
    return hits.select(row_id, "name", "start", "words").join(inside, [row_id, "start", "words"], "left_anti")
