"""Projects by the many ways their names are written in titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline.functions.text import first_alias, fold

#: Names of projects and the patterns over folded text that stand for them, tried in this order, and the name of all others.
UNKNOWN_PROJECT = "Không xác định"
PROJECT_ALIASES = {
    "Vinhomes Ocean Park": [r"vinhomes ocean park", r"\bocean park\b"],
    "Vinhomes Smart City": [r"vinhomes\s*smart\s*city", r"smart\s*city", r"smartcity"],
    "Vinhomes Gardenia": [r"vinhomes gardenia", r"\bgardenia\b"],
    "Vinhomes Green Bay": [r"green bay"],
    "Times City": [r"time?s city", r"park hill"],
    "Royal City": [r"royal city"],
    "Lumière Evergreen": [r"lumi[eè]re"],
    "Imperia Sky Garden": [r"imperia sky garden"],
    "Imperia Parkland": [r"imperia parkland"],
    "Imperia": [r"\bimperia\b"],
    "HH Linh Đàm": [r"hh[0-9abc]*\s+linh dam", r"hh.{0,8}linh dam", r"ban dao linh dam"],
    "Rice City Sông Hồng": [r"ri[cs]e city song hong"],
    "Rice City Linh Đàm": [r"rice city"],
    "Kim Văn Kim Lũ": [r"kim van kim lu"],
    "KĐT Đại Thanh": [r"(ct[0-9abz]* )?dai thanh"],
    "KĐT Linh Đàm": [r"linh dam"],
    "FLC Garden City Đại Mỗ": [r"flc .*(garden|dai mo)", r"flc garden city"],
    "FLC": [r"\bflc\b"],
    "Ecohome Phúc Lợi": [r"ecohome phuc loi"],
    "Ecohome": [r"ecohome", r"eco home"],
    "Eco Green City": [r"eco green"],
    "Masteri": [r"masteri"],
    "Goldmark City": [r"goldmark"],
    "Gold Season": [r"gold season"],
    "Mipec": [r"mipec"],
    "KĐT Ngoại Giao Đoàn": [r"ngoai giao doan", r"\bngoai giao\b"],
    "The Pride": [r"the pride"],
    "KĐT Văn Khê": [r"van khe"],
    "The Zei": [r"the zei"],
    "The Sola Park": [r"the sola"],
    "The Matrix One": [r"the matrix"],
    "The Emerald": [r"the emerald"],
    "Roman Plaza": [r"roman plaza"],
    "Five Star Kim Giang": [r"five star"],
    "HPC Landmark 105": [r"hpc landmark"],
    "Hateco": [r"hateco"],
    "Dream Town": [r"dream town"],
    "Sunshine": [r"sunshine"],
    "Gemek": [r"gemek"],
    "Feliz Homes": [r"feliz"],
    "TSQ Euroland": [r"\btsq\b"],
    "King Palace": [r"king palace"],
    "Ruby City": [r"ruby city", r"\bruby\b"],
    "Ciputra": [r"ciputra"],
    "Roman / Hồng Hà": [r"hong ha"],
    "Usilk City": [r"usilk"],
    "Gelexia Riverside": [r"gelexia"],
    "Berriver Long Biên": [r"berriver"],
    "Eurowindow River Park": [r"eurowindow"],
    "KĐT Thành Phố Giao Lưu": [r"thanh pho giao luu", r"\btp giao luu\b"],
    "X2 Đại Kim": [r"x2 dai kim"],
    "CT2A Thạch Bàn": [r"ct2a thach ban"],
}


def known_project(title: Column, aliases: dict[str, list[str]] = PROJECT_ALIASES, unknown: str = UNKNOWN_PROJECT) -> Column:
    """The project that a title names: the first in order of which a pattern is found. Most titles name none: one pattern of all patterns turns these away before the others are tried."""
    either = {name: "|".join(f"(?:{p})" for p in patterns) for name, patterns in aliases.items()}
    return F.when(fold(title).rlike("|".join(either.values())), first_alias(title, [(p, name) for name, p in either.items()], unknown)).otherwise(unknown)
