"""Raw listings of two sites under one schema, repairs of pins that a site filled in, and a table rebuilt in the order its columns need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.addresses import labelled, or_null, script_place, second_address, translated
from hearthline.functions.geo import haversine_km, in_box
from hearthline.functions.text import facing, label_by_prefix, type_by_slug
from hearthline.operators.appraisal import neighbour_prices
from hearthline.operators.lineage import cut_lineage
from hearthline.operators.market import FILLED_IN, FILLED_IN_KM, within_limits
from hearthline.operators.quality import prefer_first
from hearthline.sources.files import require

#: The second site's labels beside the first one's, labels that only end the one before, and the first site's heading and order of labels.
LABELS = {
    "Diện tích": "Diện tích", "Số phòng ngủ": "Số phòng ngủ", "Số phòng tắm, vệ sinh": "Số phòng vệ sinh", "Hướng nhà": "Hướng cửa chính", "Hướng ban công": "Hướng ban công",
    "Pháp lý": "Giấy tờ pháp lý", "Nội thất": "Tình trạng nội thất", "Số tầng": "Tầng số", "Mặt tiền": "Chiều ngang", "Đường vào": "Đường vào",
}
ENDING_LABELS = ["Khoảng giá", "Mức giá"]
HEADING = "Đặc điểm bất động sản"
LABEL_ORDER = ["Loại hình", "Diện tích", "Giấy tờ pháp lý", "Số phòng ngủ", "Số phòng vệ sinh", "Tình trạng nội thất", "Hướng ban công", "Hướng cửa chính", "Tầng số", "Chiều ngang", "Đường vào"]
#: The second site's words for papers and furniture beside the first one's (others have none), and types by a part of the address of a page, the longer ones first.
PAPERS = {
    "Sổ đỏ/ Sổ hồng": "Sổ hồng riêng", "Sổ đỏ": "Sổ hồng riêng", "Sổ hồng": "Sổ hồng riêng", "Có sổ": "Sổ hồng riêng", "Sổ đỏ/Sổ hồng": "Sổ hồng riêng",
    "Hợp đồng mua bán": "Hợp đồng mua bán", "Đang chờ sổ": "Đang chờ sổ",
}
FURNITURE = {
    "Đầy đủ": "Nội thất đầy đủ", "Full": "Nội thất đầy đủ", "Cao cấp": "Nội thất cao cấp", "Cơ bản": "Hoàn thiện cơ bản",
    "Không nội thất": "Bàn giao thô", "Bàn giao thô": "Bàn giao thô", "Nguyên bản": "Bàn giao thô",
}
SLUGS = [
    ("ban-nha-biet-thu-lien-ke", "Nhà phố liền kề"), ("ban-biet-thu-lien-ke", "Nhà phố liền kề"), ("ban-nha-mat-pho", "Nhà mặt phố, mặt tiền"),
    ("ban-shophouse", "Nhà mặt phố, mặt tiền"), ("ban-nha-rieng", "Nhà ngõ, hẻm"),
]
OTHER_HOUSE, APARTMENT = "Nhà ngõ, hẻm", "Chung cư"
#: How far (kilometres, nine of ten) places filled in from a ward and a district are off.
REFILL_ERRORS = {"new ward": 2.19, "district": 4.27}
RAW = ["title", "address", "price", "area", "attributes", "description"]


def second_site(df: DataFrame, kind: str = "apartment", row_id: str = "row_id") -> DataFrame:
    """Rows of the second site as the first one writes them: row_id, title, address, new_ward, project, price, area, description, attributes, url, listing_id, lat, lon and source.

    Rows of one listing (by the number at the end of ``url``) become one, one whose ``script`` names a place if there is one, of equals the smallest row_id; rows without a number stay.
    ``attributes`` is built anew: heading, then the first site's labels and values, those that are missing or have no word there left out. ``url`` and ``script`` may be absent.
    """
    require(df, RAW)
    given = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    rows = df.select(row_id, *RAW, given("url").alias("url"), given("script").alias("script")).withColumn("listing_id", or_null(F.regexp_extract("url", r"-pr(\d+)", 1)))
    rows = prefer_first(rows, "listing_id", F.col("script").rlike(r"latitude\s*:"), row_id)
    found, parts, (lat, lon) = labelled(F.col("attributes"), list(LABELS) + ENDING_LABELS), second_address(F.col("address")), script_place(F.col("script"))
    values = {ours: found[theirs] for theirs, ours in LABELS.items()}
    values["Giấy tờ pháp lý"] = translated(values["Giấy tờ pháp lý"], PAPERS)
    values["Tình trạng nội thất"] = translated(values["Tình trạng nội thất"], FURNITURE)
    values |= {name: or_null(facing(values[name])) for name in ("Hướng cửa chính", "Hướng ban công")}
    values["Loại hình"] = F.lit(APARTMENT) if kind == "apartment" else type_by_slug(F.coalesce("url", F.lit("")), SLUGS, OTHER_HOUSE)
    blob = F.concat(F.lit(HEADING), *(F.coalesce(F.concat(F.lit(name), values[name]), F.lit("")) for name in LABEL_ORDER))
    return rows.select(
        row_id, "title", parts["address"].alias("address"), parts["new_ward"].alias("new_ward"), parts["project"].alias("project"), "price", "area", "description",
        blob.alias("attributes"), "url", "listing_id", lat.alias("lat"), lon.alias("lon"), F.lit("second").alias("source"),
    )


def raw_listings(df: DataFrame, site: str = "first", kind: str = "apartment", row_id: str = "row_id") -> DataFrame:
    """Either site's rows with the columns that cleaning starts from: checked, with ``source`` (the site unless given) and, from a ``url``, the listing_id unless given."""
    if site == "second":
        return second_site(df, kind, row_id)
    out = require(df, RAW)
    out = out if "source" in out.columns else out.withColumn("source", F.lit(site))
    return out.withColumn("listing_id", or_null(F.regexp_extract("url", r"/(\d+)\.htm", 1))) if "url" in out.columns and "listing_id" not in out.columns else out


def repaired_places(df: DataFrame, own: str = "own", least: int = 5, most_km: float = 5.0, near_km: float = 1.5) -> DataFrame:
    """Rows (lat, lon, level, district, new_ward) whose pins can't be right get the median place of their ward, else of their district, and ``repaired`` says why.

    'filled in': on the place that the site puts where nothing was pinned. 'outside': beyond the area. 'moved': one of the row's ``own`` level within ``near_km`` of the filled-in place
    but over ``most_km`` from the median of its ward's other sound pins, of which there are ``least``. Medians are of sound pins; a null key has none. level becomes 'new ward' or
    'district', error_km what is known of these, support null; where no median is found, place, level and error are null. Sound rows and rows without a pin stay, with error_km and support null unless given.
    """
    lake = haversine_km(F.col("lat"), F.col("lon"), F.lit(FILLED_IN[0]), F.lit(FILLED_IN[1]))
    pinned = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    why = F.when(pinned & (lake < FILLED_IN_KM), "filled in").when(pinned & ~in_box(F.col("lat"), F.col("lon")), "outside")
    rows = df.withColumn("repaired", why)
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("support", "long"), ("error_km", "double")) if c not in df.columns})

    def medians(of: DataFrame, keys: list[str], name: str) -> DataFrame:
        sound = of.where(pinned & F.col("repaired").isNull()).dropna(subset=keys)
        return sound.groupBy(*keys).agg(F.median("lat").alias(f"_lat_{name}"), F.median("lon").alias(f"_lon_{name}"), F.count("*").alias(f"_n_{name}"))

    ward, district = ["district", "new_ward"], ["district"]
    rows = rows.join(medians(rows, ward, "all"), ward, "left")
    away = haversine_km(F.col("lat"), F.col("lon"), F.col("_lat_all"), F.col("_lon_all"))
    moved = F.col("repaired").isNull() & (away > most_km) & (F.col("_n_all") >= least) & (lake < near_km) & (F.col("level") == own)
    rows = rows.withColumn("repaired", F.when(F.coalesce(moved, F.lit(False)), "moved").otherwise(F.col("repaired")))
    out = rows.join(medians(rows, ward, "ward"), ward, "left").join(medians(rows, district, "district"), district, "left")
    bad = F.col("repaired").isNotNull()
    level = F.when(F.col("_n_ward").isNotNull(), "new ward").when(F.col("_n_district").isNotNull(), "district")
    error = F.when(F.col("_n_ward").isNotNull(), REFILL_ERRORS["new ward"]).when(F.col("_n_district").isNotNull(), REFILL_ERRORS["district"])
    out = out.withColumns({
        **{c: F.when(bad, F.coalesce(f"_{c}_ward", f"_{c}_district")).otherwise(F.col(c)) for c in ("lat", "lon")},
        "level": F.when(bad, level).otherwise(F.col("level")), "error_km": F.when(bad, error).otherwise(F.col("error_km")), "support": F.when(~bad, F.col("support")),
    })
    return out.drop(*(f"_{c}_{n}" for c in ("lat", "lon", "n") for n in ("all", "ward", "district")))


def rebuild(df: DataFrame, centre: tuple[float, float], labels: dict[str, list[str]], limits: dict[str, float], value: str = "ppm2", ks: tuple[int, ...] = (5, 15), own: str = "own", row_id: str = "row_id") -> DataFrame:
    """Clean rows with all that a fit needs, in the order that it needs: pins repaired, then distances to the centre from these, labels cut to known ones (``<column>_label``),
    impossible values blanked, and neighbours' prices from rows whose place the site itself gives (a row never from its own)."""
    rows = repaired_places(df, own)
    rows = rows.withColumn("centre_km", haversine_km(F.col("lat"), F.col("lon"), F.lit(centre[0]), F.lit(centre[1])))
    rows = within_limits(rows.withColumns({f"{c}_label": label_by_prefix(F.col(c), known) for c, known in labels.items()}), limits)
    rows = cut_lineage(rows)
    near = neighbour_prices(rows, rows.where(F.col("level") == own), ks, value, row_id=row_id)
    return rows.join(near, row_id, "left")


def plain_number(c: Column) -> Column:
    """A number with at most four decimals, and none that are 0 at the end."""
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string("%.4f", c.cast("double")), r"\.?0+$", ""))


def feature_label(feature: Column, names: dict[str, str], number: Column, words: Column, typical: Column) -> Column:
    """What a reader is shown of an input: its name and number with whether that is above, below or at the typical one; its name and words; else the name. An input without a name shows as it is."""
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), feature), feature)
    known = typical.isNotNull() & ~F.isnan(typical.cast("double"))
    side = F.when(number > typical, "lớn hơn").when(number < typical, "nhỏ hơn").otherwise("đúng bằng")
    beside = F.when(known, F.concat(F.lit(" — "), side, F.lit(" mức phổ biến "), plain_number(typical)))
    return F.concat(name, F.coalesce(F.concat(F.lit(" "), plain_number(number), F.coalesce(beside, F.lit(""))), F.concat(F.lit(" "), words), F.lit("")))
