"""Addresses as sites write them, what a geocoder is asked about them, and repairs of their districts, as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions.text import address_part, collapse, district_key, ward_key

#: The words before names of streets, wards and all administrative units, and the city.
STREET_KINDS = ("Đường", "Phố", "Ngõ", "Ngách", "Hẻm")
WARD_KINDS = ("Phường", "Xã", "Thị trấn")
UNIT_KINDS = ("Phường", "Xã", "Thị trấn", "Quận", "Huyện", "Thị xã")
CITY, COUNTRY = "Hà Nội", "Việt Nam"
#: What may stand before a street's name: a word with a number or code, and a house number with its comma.
CLUTTER = r"(?iu)^(?:số nhà|số|lô đất|lô|căn|ô|tổ|khu|kđt|kdt|dự án|toà|tòa|block)\s*[\p{L}\p{N}_/\-.]*\s*[,.]?\s*"
HOUSE_NUMBER = r"^\d+[a-zA-Z]?\s*[/\-]?\s*[\d a-zA-Z/]*?\s*,\s*"
#: The widest latitudes and longitudes that a place may have.
COUNTRY_BOX = (8.0, 24.0, 102.0, 110.0)
#: Patterns made of these.
OLD_DISTRICT = rf"\s*\((.+?),\s*{CITY}\s*cũ\)"
CITY_AT_END = rf",?\s*{CITY}\s*$"
WARD = rf"(?:{'|'.join(WARD_KINDS)})\s+[^,]+"
STREET = rf"(?iu)^(?:{'|'.join(STREET_KINDS)})\s+"
NUMBERED = r"(?iu)^(?:số\s*)?\d"
UNIT = rf"(?iu)^(?:{'|'.join(UNIT_KINDS)})\s+"
EDGES = r"^[ ,.]+|[ ,.]+$"


def or_null(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def _last(pieces: Column, keep) -> Column:
    return F.try_element_at(F.filter(pieces, keep), F.lit(-1))


def second_address(address: Column) -> dict[str, Column]:
    """Of 'number, project, street, ward, Hà Nội (district, Hà Nội cũ)': address ('street, ward, district, Hà Nội', without those that are missing), new_ward, district and project.

    The street is the last piece before the ward that begins like one, the project the last other piece that does not begin with a number;
    without both, the last piece is the street. All are null for a null or blank text.
    """
    t = or_null(collapse(address))
    district = or_null(F.trim(F.regexp_extract(t, OLD_DISTRICT, 1)))
    before = F.regexp_replace(F.regexp_replace(t, OLD_DISTRICT + ".*$", ""), r"[,\s]+$", "")
    before = F.regexp_replace(before, CITY_AT_END, "")
    ward = or_null(F.trim(F.regexp_extract(before, WARD, 0)))
    pieces = F.filter(F.transform(F.split(F.regexp_replace(before, WARD + ".*$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    named = _last(pieces, lambda x: x.rlike(STREET))
    project = _last(pieces, lambda x: F.coalesce(x != named, F.lit(True)) & ~x.rlike(NUMBERED))
    street = F.coalesce(named, F.when(project.isNull(), F.try_element_at(pieces, F.lit(-1))))
    return {"address": F.when(t.isNotNull(), F.concat_ws(", ", street, ward, district, F.lit(CITY))), "new_ward": ward, "district": district, "project": project}


def script_place(script: Column) -> tuple[Column, Column]:
    """The first latitude and longitude of a page's script; both are null where one is missing or they are outside the country."""
    lat, lon = (F.regexp_extract(script, rf"\b{name}\s*:\s*(-?\d{{1,3}}(?:\.\d+)?)", 1).try_cast("double") for name in ("latitude", "longitude"))
    low, high, west, east = COUNTRY_BOX
    good = lat.between(low, high) & lon.between(west, east)
    return F.when(good, lat), F.when(good, lon)


def labelled(blob: Column, labels: list[str]) -> dict[str, Column]:
    """The value after each label, up to the next label that stands by itself; null where there is none. Of a repeated label the first counts."""
    t, stops = collapse(blob), "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
    return {x: or_null(F.trim(F.regexp_extract(t, rf"{re.escape(x)}\s+(.+?)(?=\s+(?:{stops})\s|$)", 1))) for x in labels}


def translated(value: Column, words: dict[str, str]) -> Column:
    """What the words say for a value without its closing dots; null for others."""
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return F.try_element_at(table, F.regexp_replace(F.trim(value), r"\.+$", ""))


def street_candidates(street: Column, most: int = 3) -> Column:
    """Up to ``most`` spellings to look a street up by, the barest first: without clutter and house number, without the house number, as it is, its last piece.

    Commas become spaces; spellings of two letters or fewer go. An empty array for a null or blank street.
    """
    edged = lambda c: F.regexp_replace(c, EDGES, "")
    bare = lambda c: F.regexp_replace(c, HOUSE_NUMBER, "")
    raw = edged(collapse(F.coalesce(street, F.lit(""))))
    forms = F.array(bare(F.regexp_replace(raw, CLUTTER, "")), bare(raw), raw, F.element_at(F.split(raw, ","), -1))
    plain = F.transform(forms, lambda x: edged(collapse(F.replace(x, F.lit(","), F.lit(" ")))))
    return F.slice(F.array_distinct(F.filter(plain, lambda x: F.length(x) > 2)), 1, most)


def street_queries(street: Column, ward: Column) -> Column:
    """What a geocoder is asked, the surest first, as structs: each candidate with its ward as one text, then each as a street of the city. Without a ward only the latter."""
    spellings, none = street_candidates(street), F.lit(None).cast("string")
    unit = or_null(F.trim(F.regexp_replace(ward, UNIT, "")))
    texts = F.transform(spellings, lambda x: F.struct(F.concat_ws(", ", x, unit, F.lit(CITY), F.lit(COUNTRY)).alias("text"), none.alias("street"), none.alias("city"), none.alias("country")))
    bare = F.transform(spellings, lambda x: F.struct(none.alias("text"), x.alias("street"), F.lit(CITY).alias("city"), F.lit(COUNTRY).alias("country")))
    return F.concat(F.filter(texts, lambda x: unit.isNotNull()), bare)


def repaired_units(district: Column, ward: Column, address: Column, districts: list[str]) -> dict[str, Column]:
    """district, ward and their keys, read again from the address's end where the district's key is none of ``districts`` (keys of all there are) and the address names one that is.

    The ward follows only if the address has one. A null district stays; what the address can't mend stays too.
    """
    said, again = district_key(district), address_part(address, r"^(?:quan|huyen|thi xa)\s+")
    wrong = F.coalesce(~said.isin(districts) & district_key(again).isin(districts), F.lit(False))
    named = address_part(address, r"^(?:phuong|xa|thi tran)\s+")
    out = {"district": F.when(wrong, again).otherwise(district), "ward": F.when(wrong & named.isNotNull(), named).otherwise(ward)}
    return out | {"district_key": district_key(out["district"]), "ward_key": ward_key(out["ward"]), "mended": wrong}
