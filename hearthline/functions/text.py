"""Reading noisy Vietnamese classified text with built-in Column functions: folding, numbers, prices, sizes, keys, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each ASCII letter and the precomposed Vietnamese letters that fold to it.
VIETNAMESE = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ", "d": "đ", "e": "èéẻẽẹêềếểễệ", "i": "ìíỉĩị", "o": "òóỏõọôồốổỗộơờớởỡợ", "u": "ùúủũụưừứửữự", "y": "ỳýỷỹỵ",
    "c": "ç", "n": "ñ",
}
#: Units of price.
TY, TRIEU = 1e9, 1e6


def fold(c: Column | str) -> Column:
    """Lower case without accents; null is empty. Precomposed and decomposed letters fold alike."""
    c = F.col(c) if isinstance(c, str) else c
    letters = "".join(VIETNAMESE.values()) + "äëïöüÿåãõ"
    plain = "".join(a * len(many) for a, many in VIETNAMESE.items()) + "aeiouyaao"
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), letters, plain), r"\p{Mn}+", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is no match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _number(c: Column) -> Column:
    """A decimal with a comma or a dot."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def vietnamese_number(token: Column) -> Column:
    """A numeric token by its shape: dot and comma (dot groups thousands), comma (decimal), dots before groups of three (thousands), else decimal dot."""
    t = F.regexp_replace(F.trim(token), r"[.,]+$", "")
    dot, comma = t.contains("."), t.contains(",")
    bare = F.replace(t, F.lit("."), F.lit(""))
    return F.when(dot & comma, _number(bare)).when(comma, _number(t)).when(t.rlike(r"^\d{1,3}(?:\.\d{3})+$"), bare.try_cast("double")).otherwise(t.try_cast("double"))


def first_number(c: Column) -> Column:
    return vietnamese_number(_group(c.cast("string"), r"([\d.,]+)"))


def area(c: Column) -> Column:
    """Square metres of '47 m²' or '66.12 m²'."""
    return first_number(c)


def price(c: Column) -> Column:
    """VND of '6,558 tỷ' or '650 triệu'. Every dot groups thousands; tỷ is looked for first."""
    t = F.replace(fold(c), F.lit("."), F.lit(""))
    billions, millions = _group(t, r"([\d,]+)\s*ty"), _group(t, r"([\d,]+)\s*trieu")
    return F.when(c.isNotNull(), F.when(billions.isNotNull(), _number(billions) * TY).otherwise(_number(millions) * TRIEU))


def price_per_area(c: Column) -> Column:
    """VND per m² of '1,60 tỷ/m²', '93,04 triệu/m²' or '850.000 đ/m²'."""
    t, n = fold(c), first_number(c)
    return F.when(t.contains("ty/m") | t.rlike(r"\bty\b"), n * TY).when(t.contains("trieu"), n * TRIEU).otherwise(n)


def parse_error(price_: Column, area_: Column, stated: Column) -> Column:
    """Relative gap between price / area and the stated price per area; null where one is missing or the stated one is not positive."""
    return F.when((stated > 0) & (area_ != 0), F.abs(price_ / area_ - stated) / stated)


def price_hint(c: Column) -> Column:
    """A price named in a title: '1t7', '5,4 tỷ', '12 tỉ', '850tr'; the first shape that reads."""
    t = fold(c)
    whole, tenth = _group(t, r"\b(\d{1,3})\s*t\s*(\d)\b"), _group(t, r"\b(\d{1,3})\s*t\s*(\d)\b", 2)
    billions = _number(_group(t, r"\b([\d,]+(?:\.\d+)?)\s*t[yi]\b")) * TY
    millions = _number(_group(t, r"\b([\d,]+)\s*(?:tr|trieu)\b")) * TRIEU
    return F.coalesce(F.concat(whole, F.lit("."), tenth).try_cast("double") * TY, billions, millions)


def _first_fit(t: Column, patterns: list[str], low: float, high: float) -> Column:
    """The number that the first pattern finds within [low, high]; each pattern has one try, its first match."""
    found = [_number(_group(t, p)) for p in patterns]
    return F.coalesce(*(F.when(v.between(low, high), v) for v in found))


#: Patterns over folded text and their plausible ranges.
FLOOR = ([r"\btang\s*(\d{1,2})\b", r"\bt\s*(\d{1,2})\b(?!\s*t)"], 1, 60)
STOREYS = ([r"(\d{1,2}(?:[.,]5)?)\s*tang\b", r"\bxay\s*(\d{1,2})\s*t\b", r"\b(\d{1,2})\s*t\b(?=\s*[,.\-–|]|$)"], 1, 20)
FRONTAGE = (
    [r"(?:mat tien|\bmt\b|chieu ngang)\s*:?\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*m", r"\b(\d{1,2}(?:[.,]\d{1,2})?)\s*m?(?!2|²)\s*[x×]\s*\d{1,3}(?:[.,]\d{1,2})?\s*m(?!2|²)"],
    1.5, 50.0,
)
DEPTH = ([r"\b\d{1,2}(?:[.,]\d{1,2})?\s*m?\s*[x×]\s*(\d{1,3}(?:[.,]\d{1,2})?)\s*m"], 2.0, 200.0)
ROAD_WIDTH = ([r"(?:ngo|duong|hem|ngach)\s*(?:truoc nha\s*)?(?:rong\s*)?:?\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*m"], 0.8, 60.0)
MENTIONS = {
    "car": r"o ?to|oto|xe hoi", "lift": r"thang may", "pool": r"be boi|ho boi", "gym": r"\bgym\b|phong tap", "school": r"truong hoc|truong cap|mam non|dai hoc",
    "hospital": r"benh vien|phong kham", "market": r"\bcho\b|sieu thi|vincom|bigc|big c", "park": r"cong vien|ho dieu hoa", "metro": r"metro|duong sat tren cao|nhon|cat linh",
    "business": r"kinh doanh|van phong|cho thue|mat bang", "owner": r"chinh chu", "view": r"\bview\b", "corner": r"lo goc|can goc", "widening": r"no hau", "repair": r"nha nat|can sua|xuong cap",
}


def floor(c: Column) -> Column:
    return _first_fit(fold(c), *FLOOR)


def storeys(c: Column) -> Column:
    return _first_fit(fold(c), *STOREYS)


def frontage(c: Column) -> Column:
    return _first_fit(fold(c), *FRONTAGE)


def depth(c: Column) -> Column:
    return _first_fit(fold(c), *DEPTH)


def road_width(c: Column) -> Column:
    return _first_fit(fold(c), *ROAD_WIDTH)


def mentions(*texts: Column) -> dict[str, Column]:
    """A 0/1 column for each entry of MENTIONS, over all texts together."""
    t = fold(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in texts)))
    return {f"mentions_{name}": t.rlike(p).cast("int") for name, p in MENTIONS.items()}


def fill_from_text(value: Column, text: Column, reader) -> Column:
    """The value, or where it is null what reader finds in the text."""
    return F.coalesce(value, reader(text))


def sane_dimensions(area_: Column, front: Column, deep: Column, ratio: float = 3.0) -> tuple[Column, Column]:
    """Frontage up to the root of ratio * area and depth up to area / 1.5; what is beyond becomes null, and what can't be judged stays."""
    return F.when(~F.coalesce(front > F.sqrt(area_ * ratio), F.lit(False)), front), F.when(~F.coalesce(deep > area_ / 1.5, F.lit(False)), deep)


#: Generic words in front of and in names, over folded text.
STREET_PREFIXES = ("duong", "pho", "ngo", "ngach", "hem", "to dan pho", "to", "khu do thi", "khu", "so nha", "so", "dg")
WARD_PREFIXES = ("phuong", "xa", "thi tran", "tt")
DISTRICT_PREFIXES = ("quan", "huyen", "thi xa", "tp", "thanh pho")
PROJECT_WORDS = ("chung cu", "khu do thi moi", "khu do thi", "kdt", "du an", "toa nha", "toa", "cc", "can ho", "khu can ho", "block")


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _without_prefix(key: Column, prefixes: tuple[str, ...]) -> Column:
    return F.regexp_replace(key, f"^(?:{'|'.join(prefixes)})\\s+", "")


def name_key(c: Column) -> Column:
    """Folded letters and digits, one space between runs; null if there are none, so that missing names match nothing."""
    return _or_null(collapse(F.regexp_replace(fold(c), r"[^a-z0-9]+", " ")))


def street_key(c: Column, rounds: int = 4) -> Column:
    """A street's name without the words and numbers before it ('ngõ 12 ngách 3 ...'), nested up to ``rounds`` deep; null if nothing is left."""
    key = name_key(c)
    for _ in range(rounds):
        key = F.regexp_replace(_without_prefix(key, STREET_PREFIXES), r"^\d+\s*", "")
    return _or_null(key)


def ward_key(c: Column) -> Column:
    """A ward's name without its kind."""
    return _or_null(_without_prefix(name_key(c), WARD_PREFIXES))


def district_key(c: Column) -> Column:
    """A district's name without its kind."""
    return _or_null(_without_prefix(name_key(c), DISTRICT_PREFIXES))


def project_key(c: Column) -> Column:
    """A project's name without generic words; null if nothing is left."""
    return _or_null(collapse(F.regexp_replace(name_key(c), f"\\b(?:{'|'.join(PROJECT_WORDS)})\\b", " ")))


def facing(c: Column) -> Column:
    """'Đông - Nam' as 'Đông Nam'."""
    return collapse(F.regexp_replace(c, r"\s*-\s*", " "))


def address_part(address: Column, pattern: str) -> Column:
    """The last comma-parted piece of an address whose folded form has the pattern."""
    pieces = F.transform(F.split(address, ","), lambda x: F.trim(x))
    return F.try_element_at(F.filter(pieces, lambda x: fold(x).rlike(pattern)), F.lit(-1))


def label_by_prefix(c: Column, labels: list[str]) -> Column:
    """The longest of the labels that the folded text begins with, else null."""
    t, out = fold(c), F.lit(None).cast("string")
    for label in sorted(labels, key=len):
        out = F.when(t.startswith(fold(F.lit(label))), F.lit(label)).otherwise(out)
    return out


def attributes(blob: Column, labels: list[str]) -> Column:
    """'Label one valueLabel two value' as a map: the labels are known, longer ones go first, and of a repeated label the first counts."""
    either = "|".join(sorted((l.replace("/", r"\/") for l in labels), key=len, reverse=True))
    pairs = F.transform(F.regexp_extract_all(blob, F.lit(f"({either})(.*?)(?=(?:{either})|$)"), F.lit(0)), lambda p: F.struct(F.regexp_extract(p, f"^({either})", 1).alias("k"), F.trim(F.regexp_replace(p, f"^(?:{either})", "")).alias("v")))
    distinct = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def first_alias(text: Column, aliases: list[tuple[str, str]], unknown: str = "unknown") -> Column:
    """The name of the first pattern, in order, that the folded text has."""
    t = fold(text)
    return F.coalesce(*(F.when(t.rlike(p), F.lit(name)) for p, name in aliases), F.lit(unknown))


def money(c: Column) -> Column:
    """'6.56 tỷ' or '650 triệu'."""
    return F.when(c >= TY, F.concat(F.format_number(c / TY, 2), F.lit(" tỷ"))).otherwise(F.concat(F.format_number(c / TRIEU, 0), F.lit(" triệu")))


def business_key(price_: Column, area_: Column, ward: Column, description: Column) -> Column:
    """Listings that agree in it are taken for one: price to a million, area to a tenth, ward, the description's first 120 characters."""
    return F.concat_ws("|", F.bround(price_, -6).cast("string"), F.bround(area_, 1).cast("string"), F.coalesce(ward, F.lit("")), F.substring(F.coalesce(description, F.lit("")), 1, 120))


def written_date(c: Column, *patterns: str) -> Column:
    """The day that a text gives in the first of the patterns ('31/12/2024' by default) that it has; null for others and for days that are none."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(p)).cast("date") for p in patterns or ("dd/MM/yyyy",)))


def html_number(c: Column) -> Column:
    """A number of a page with its unit: dots group thousands only beside a comma, else either sign is a decimal one."""
    t = fold(c)
    token = _group(t, r"([\d.,]+)")
    token = F.when(token.contains(".") & token.contains(","), F.replace(token, F.lit("."), F.lit(""))).otherwise(token)
    return _number(token) * F.when(t.contains("ty"), TY).when(t.contains("trieu"), TRIEU).otherwise(1.0)


def geocode_query(*parts: Column) -> Column:
    """The parts that are not blank, joined by commas."""
    return F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def feature_flags(c: Column, features: dict[str, str]) -> dict[str, Column]:
    """A 0/1 column for each feature: whether the folded text holds its folded words as they are."""
    t = fold(c)
    return {f"has_{name}": t.contains(fold(F.lit(words))).cast("int") for name, words in features.items()}


def type_by_slug(url: Column, slugs: list[tuple[str, str]], default: str) -> Column:
    """The type of the first slug, in order, that the address holds."""
    return F.coalesce(*(F.when(url.contains(slug), F.lit(name)) for slug, name in slugs), F.lit(default))


def wrong_level(district: Column, ward: Column) -> Column:
    """Whether a rural ward ('xã') is said to be in an urban district ('quận'), which no map has."""
    return F.coalesce(fold(ward).rlike(r"^xa\b") & fold(district).rlike(r"^quan\b"), F.lit(False))


def address_parts(address: Column) -> dict[str, Column]:
    """street (all before the ward, else before the district), ward and district of 'street, Phường X, Quận Y, city'; null where there is none."""
    t = collapse(address)
    ward, district = (_group(t, rf"(?iu)(?:^|,)\s*((?:{kinds})\s+[^,]+)") for kinds in ("phường|xã|thị trấn", "quận|huyện|thị xã"))
    street = F.regexp_replace(F.regexp_replace(t, r"(?iu)(?:^|,)\s*(?:phường|xã|thị trấn)\s.*$", ""), r"(?iu)(?:^|,)\s*(?:quận|huyện|thị xã)\s.*$", "")
    return {"street": _or_null(F.trim(street)), "ward": ward, "district": district}
