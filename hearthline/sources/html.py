"""Fields of raw listing pages, by regular expressions in Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.functions.text import html_number, name_key

#: The entities that pages use.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain_text(html: Column) -> Column:
    """Without scripts, styles and tags; the common entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, sign in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def first_tag(html: Column, tag: str) -> Column:
    """The plain text of the first such element, null if there is none."""
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    return F.when(html.rlike(pattern), plain_text(F.regexp_extract(html, pattern, 1)))


def links(html: Column) -> Column:
    """The distinct href values, in the order in which they first occur."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)))


def pairs(html: Column, pattern: str) -> Column:
    """A map of the pattern's two groups; a key's last value counts."""
    found = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda m: F.struct(plain_text(F.regexp_extract(m, pattern, 1)).alias("k"), plain_text(F.regexp_extract(m, pattern, 2)).alias("v")))
    keys = F.array_distinct(F.transform(found, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda p: p["k"] == k), -1)["v"]))


def script_number(html: Column, name: str) -> Column:
    """The last numeric value of a field of a JavaScript object, null if there is none."""
    found = F.try_element_at(F.regexp_extract_all(html, F.lit(rf"\b{name}\s*:\s*['\"]?(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), F.lit(-1)).try_cast("double")
    return F.when(html.contains(name), found)  # most pages lack most fields, and plain text is found faster


def tags(html: Column, *names: str) -> Column:
    """Which of the elements (names, or patterns of names) a page has, distinct, in the order in which they first occur."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf"<({'|'.join(names)})\b"), F.lit(1)))


def listing_links(pages: DataFrame, html: str, pattern: str = r'href="([^"]*-pr(\d+))"') -> DataFrame:
    """id and url of the listings that list pages link to; of a repeated id the first url by name."""
    found = pages.select(F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("m"))
    return found.select(F.regexp_extract("m", pattern, 2).alias("id"), F.regexp_extract("m", pattern, 1).alias("url")).groupBy("id").agg(F.min("url").alias("url"))


#: Where a listing's page keeps its short facts, its details, its addresses and its description, and the end of a new ward's line.
FACTS = r'(?s)class="re__pr-short-info-item[^"]*"[^>]*>\s*<span class="title"[^>]*>(.*?)</span>\s*<span class="value"[^>]*>(.*?)</span>'
DETAILS = r'(?s)class="re__pr-specs-content-item-title"[^>]*>(.*?)</span>\s*<span class="re__pr-specs-content-item-value"[^>]*>(.*?)</span>'
ADDRESS = r'(?s)class="re__address-line-1"[^>]*>(.*?)</span>'
NEW_WARD = r'(?s)class="re__address-line-2\s*"[^>]*>(.*?)</span>'
DESCRIPTION = r'(?s)class="[^"]*detail-content[^"]*"[^>]*>(.*?)</div>'
NEW_CITY = r",?\s*(?:Hà Nội|TP Hà Nội)\s*mới\s*$"


def shown(html: Column, pattern: str) -> Column:
    """The pattern's two groups in the order of the page, as an array of structs (key: folded, k, v)."""
    both = F.arrays_zip(*(F.regexp_extract_all(html, F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "k"), (2, "v"))))
    plain = F.transform(both, lambda p: F.struct(plain_text(p["k"]).alias("k"), plain_text(p["v"]).alias("v")))
    return F.transform(plain, lambda p: F.struct(name_key(p["k"]).alias("key"), p["k"].alias("k"), p["v"].alias("v")))


def _value(found: Column, key: str) -> Column:
    """A value of shown() by the folded key: of keys that fold alike the one that begins last, of equal ones the last value."""
    own = F.filter(found, lambda p: p["key"] == key)
    last = F.try_element_at(F.array_distinct(F.transform(own, lambda p: p["k"])), F.lit(-1))
    return F.try_element_at(F.filter(own, lambda p: p["k"] == last), F.lit(-1))["v"]


def listing_pages(pages: DataFrame, html: str, url: str, *keep: str) -> DataFrame:
    """keep and the columns of listing_page(). What a page shows is read once, in a step of its own, not once for every column that looks into it."""
    read = pages.select(*keep, F.col(html).alias("_html"), F.col(url).alias("_url"), shown(F.col(html), FACTS).alias("_facts"), shown(F.col(html), DETAILS).alias("_details"))
    return read.select(*keep, *(c.alias(n) for n, c in listing_page(F.col("_html"), F.col("_url"), F.col("_facts"), F.col("_details")).items()))


def listing_page(html: Column, url: Column, facts: Column | None = None, details: Column | None = None) -> dict[str, Column]:
    """The 27 columns of a listing's page: numbers of its script first, price and area else from the facts shown; what a page lacks is null. ``facts`` and ``details``: shown() of FACTS and DETAILS, where they are read already."""
    facts, details = shown(html, FACTS) if facts is None else facts, shown(html, DETAILS) if details is None else details
    inside = lambda pattern: F.when(html.rlike(pattern), plain_text(F.regexp_extract(html, pattern, 1)))
    number = lambda name: script_number(html, name)
    whole = lambda name: number(name).cast("long")
    return {
        "listing_id": F.coalesce(_value(facts, "ma tin"), whole("productId").cast("string")), "url": url, "title": first_tag(html, "h1"),
        "price": F.coalesce(number("price"), html_number(_value(facts, "khoang gia"))), "ppm2": number("pricePerM2"), "area": F.coalesce(number("area"), html_number(_value(facts, "dien tich"))),
        "lat": number("latitude"), "lon": number("longitude"), "ward_id": whole("wardId"), "district_id": whole("districtId"), "street_id": whole("streetId"), "project_id": whole("projectId"),
        "city_code": F.try_element_at(F.regexp_extract_all(html, F.lit(r"\bcityCode\s*:\s*'([^']*)'"), F.lit(1)), F.lit(-1)), "product_type": whole("productType"), "category_id": whole("categoryId"),
        "address": inside(ADDRESS), "new_ward": F.trim(F.regexp_replace(F.regexp_replace(inside(NEW_WARD), r"^[() ]+|[() ]+$", ""), NEW_CITY, "")),
        "posted": _value(facts, "ngay dang"), "expires": _value(facts, "ngay het han"), "tier": _value(facts, "loai tin"),
        "bedrooms": html_number(_value(details, "so phong ngu")), "bathrooms": html_number(_value(details, "so phong tam ve sinh")), "facing": _value(details, "huong nha"),
        "balcony": _value(details, "huong ban cong"), "papers": _value(details, "phap ly"), "furniture": _value(details, "noi that"), "description": inside(DESCRIPTION),
    }
