"""One type for each column of values that come in several: counted over all rows, chosen so that no value is lost, checked after writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.lineage import cut_lineage

#: Types and the kinds of values that they hold without loss; other mixtures are text.
HOLDS = {"bigint": {"whole", "long"}, "double": {"whole", "fraction"}, "boolean": {"boolean"}, "date": {"date"}}
UNREAD = "unread"


def _number_kind(t: Column) -> Column:
    """whole (up to 15 digits, so a double holds it too), long (up to 18), fraction (a double prints it again: up to 15 digits, or 17 that come back) or exact, which only text holds."""
    whole = t.rlike(r"^(0|-?[1-9][0-9]*)$")
    mantissa = F.regexp_replace(t, r"[eE].*$", "")
    digits = F.length(F.regexp_replace(F.regexp_replace(mantissa, r"[^0-9]", ""), r"^0+", ""))
    value = F.abs(t.try_cast("double"))
    again = F.coalesce(value.cast("string").try_cast("decimal(38,18)") == F.abs(t.try_cast("decimal(38,18)")), F.lit(False))
    held = (value.between(1e-300, 1e300) & ((digits <= 15) | ((digits <= 17) & value.between(0.01, 1e16) & again))) | ((digits == 0) & ~t.startswith("-"))
    return F.when(whole & (digits <= 15), "whole").when(whole & (digits <= 18), "long").when(~whole & held, "fraction").otherwise("exact")


def _word_kind(t: Column) -> Column:
    """date for a day written as 2024-01-31 that there is, else text."""
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & t.try_cast("date").isNotNull(), "date").otherwise("text")


def _maps(payload: Column) -> tuple[Column, Column, Column]:
    """Texts and variants by field of a JSON object, and whether it can be read: an object without repeated fields."""
    texts, forms = F.from_json(payload, "map<string,string>"), F.from_json(payload, "map<string,variant>")
    names = F.map_keys(texts)
    return texts, forms, F.coalesce(F.size(F.array_distinct(names)) == F.size(names), F.lit(False))


def _exact(text: Column, value: Column, form: Column) -> Column:
    """A cell's text; decimals as the variant keeps them, all their digits and no zeros at the end."""
    return F.when(form.startswith("DECIMAL"), F.try_variant_get(value, "$", "string")).otherwise(text)


def json_kinds(df: DataFrame, payload: str) -> DataFrame:
    """column, kind, n: how many values of each kind the fields of a JSON text have over all rows.

    Nulls are no values; texts that are no object, or repeat a field, have no fields. Fractions of more than 38 digits are doubles, as for any reader of JSON.
    """
    texts, forms, read = _maps(F.col(payload))
    each = df.select(F.when(read, texts).alias("texts"), F.when(read, forms).alias("forms")).select("forms", F.explode("texts").alias("column", "text")).where("text IS NOT NULL")
    each = each.withColumn("value", F.element_at("forms", F.col("column"))).withColumn("form", F.schema_of_variant("value"))
    form, text = F.col("form"), F.col("text")
    number, dotted = _number_kind(_exact(text, F.col("value"), form)), text.rlike("[.eE]")
    number = F.when(dotted & (number == "whole"), "fraction").when(dotted & (number == "long"), "exact").otherwise(number)  # 37.0 is no whole number
    kind = F.when(form == "BOOLEAN", "boolean").when(form.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number).when(form == "STRING", _word_kind(text)).otherwise("nested")
    return each.select("column", kind.alias("kind")).groupBy("column", "kind").agg(F.count("*").alias("n"))


def text_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, kind, n of text columns, as a CSV has them, by what the texts read as; a number with leading zeros or signs of its own is text. Empty texts are text, nulls no values."""
    t = F.col("text")
    number = t.rlike(r"^(0|-?[1-9][0-9]*|-?(0|[1-9][0-9]*)\.[0-9]+)$")
    kind = F.when(t.isin("true", "false"), "boolean").when(number, _number_kind(t)).otherwise(_word_kind(t))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")) for c in columns))).alias("p")
    return df.select(pairs).select("p.*").where("text IS NOT NULL").select("column", kind.alias("kind")).groupBy("column", "kind").agg(F.count("*").alias("n"))


def column_report(kinds: DataFrame) -> DataFrame:
    """column, n, kinds ('text:3,whole:5'), type, and moved: how many values take another type than their own, as whole numbers among fractions or numbers among texts do."""
    found = F.collect_set("kind")
    type_ = F.lit("string")
    for name, held in reversed(HOLDS.items()):
        type_ = F.when(F.size(F.array_except(F.col("found"), F.array(*map(F.lit, sorted(held))))) == 0, name).otherwise(type_)
    out = kinds.groupBy("column").agg(
        F.sum("n").alias("n"), found.alias("found"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string")))), ",").alias("kinds"),
        *(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"_{k}") for k in ("whole", "text", "date")),
    )
    out = out.withColumn("type", type_)
    moved = F.when(F.col("type") == "double", F.col("_whole")).when(F.col("type") == "string", F.col("n") - F.col("_text") - F.col("_date")).otherwise(F.lit(0))
    return out.select("column", "n", "kinds", "type", moved.cast("long").alias("moved"))


def column_types(report: DataFrame, most: int = 5_000) -> dict[str, str]:
    """Types by column. One row a column comes to the driver; a payload with more than ``most`` fields is no table, and raises."""
    rows = report.select("column", "type").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} columns: a field of many names is a map, not columns")
    return {r["column"]: r["type"] for r in sorted(rows)}


def typed_json(df: DataFrame, payload: str, types: dict[str, str]) -> DataFrame:
    """df with a column for each field in its type, in place of the payload; and ``unread``: the payload itself where it is no object without repeated fields. A field named like another column raises."""
    kept = [c for c in df.columns if c != payload]
    names = [c.lower() for c in [*kept, *types, UNREAD]]
    if twice := sorted({c for c in names if names.count(c) > 1}):
        raise ValueError(f"columns twice: {', '.join(twice)}")
    texts, forms, read = _maps(F.col(payload))
    rows = df.select(F.struct(*(f"`{c}`" for c in kept)).alias("kept"), F.col(payload).alias("payload"), F.when(read, texts).alias("texts"), F.when(read, forms).alias("forms"), read.alias("read"))
    cell = lambda c, t: F.col("texts").getItem(c).cast(t) if t != "string" else _exact(F.col("texts").getItem(c), F.col("forms").getItem(c), F.schema_of_variant(F.col("forms").getItem(c)))
    return rows.select("kept.*", *(cell(c, t).alias(c) for c, t in types.items()), F.when(~F.col("read"), F.col("payload")).alias(UNREAD))


def typed_text(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with text columns cast to their types; columns without a type stay."""
    return df.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns))


def write_reconciled(df: DataFrame, payload: str, path: str) -> dict[str, str]:
    """Writes ``typed_json`` as Parquet and returns the types. The file is read back: a column with fewer or more values than were counted raises, so no cell gets lost in a cast."""
    report = cut_lineage(column_report(json_kinds(df, payload)))
    types = column_types(report)
    typed_json(df, payload, types).write.mode("errorifexists").parquet(path)
    if not types:
        return types
    written = df.sparkSession.read.parquet(path).agg(*(F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(types))).first()
    counted = {r["column"]: r["n"] for r in report.collect()}
    if lost := [c for i, c in enumerate(types) if written[i] != counted[c]]:
        raise ValueError(f"values lost or added in: {', '.join(lost)}")
    return types
