"""Queries of text models and of models' metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators import regression, report, textmodel, valuation
from hearthline.operators.market import position
from hearthline.plans.registry import query, rounded
from hearthline.plans.views import LISTING, listing, spread, table

FOLDS = 4
#: DuckDB: the fold of a text id, as valuation.fold_of() gives it.
FOLD_OF = "(('0x' || substr(md5({id}::VARCHAR), 1, 8))::BIGINT % {n})::INT"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    turns = spread(table(spark, d, "conversations"), "conv_id").withColumn("row_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return turns.select("row_id", "text", valuation.fold_of(F.col("row_id"), FOLDS).alias("fold"))


@query(f"""WITH t AS (SELECT {FOLD_OF.format(id="(conv_id || ':' || turn)", n=FOLDS)} AS fold, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w, conv_id || ':' || turn AS id FROM conversations),
x AS (SELECT fold, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
c AS (SELECT term, fold, count(DISTINCT id) AS d, count(*) AS n FROM x GROUP BY ALL), f AS (SELECT fold, (SELECT count(*) FROM t) - count(*) AS rows FROM t GROUP BY fold),
a AS (SELECT term, sum(d) AS d, sum(n) AS n FROM c GROUP BY term), l AS (
  SELECT f.fold, a.term, rows, a.d - coalesce(c.d, 0) AS documents, a.n - coalesce(c.n, 0) AS n FROM a CROSS JOIN f LEFT JOIN c ON c.term = a.term AND c.fold = f.fold WHERE a.d - coalesce(c.d, 0) >= 3
) SELECT fold, term, documents::BIGINT AS documents, round(ln((1 + rows) / (1 + documents)) + 1, 6) AS idf FROM l QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, term) <= 500""")
def fold_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """The 500 most frequent words and pairs of words outside each fold of conversation turns, with their weights."""
    out = textmodel.fold_vocabularies(_turns(spark, d), "text", "fold", most=500)
    return out.select("fold", "term", "documents", F.round("idf", 6).alias("idf"))


@query()
def text_components(spark: SparkSession, d: str) -> DataFrame:
    """Four text components of every conversation turn, by the model of the other folds."""
    return textmodel.text_components(_turns(spark, d), "text", "fold", FOLDS, components=4, most=2000)


#: DuckDB: an out-of-fold table of listings: the mean price of the ward in the other folds, less or more three tenths.
OUT_OF_FOLD = f"""{LISTING},
l AS (SELECT *, {FOLD_OF.format(id="row_id", n=5)} AS fold FROM listing WHERE price > 0), s AS (SELECT ward, fold, sum(round(price * 100)::BIGINT)::BIGINT AS s, count(*) AS n FROM l GROUP BY ALL),
o AS (SELECT ward, fold, (sum(s) OVER (PARTITION BY ward) - s)::DOUBLE / (100 * (sum(n) OVER (PARTITION BY ward) - n))::DOUBLE AS predicted FROM s), p AS (SELECT l.*, predicted, 0.5::DOUBLE * predicted AS low, 1.6::DOUBLE * predicted AS high FROM l JOIN o USING (ward, fold))"""

LEVELS = {"all": [], "branch": ["segment"], "district": ["segment", "district"], "ward": ["segment", "district", "ward"]}


def _priced(spark: SparkSession, d: str) -> DataFrame:
    rows = listing(spark, d).where("price > 0").withColumn("fold", valuation.fold_of(F.col("row_id")))
    cells = rows.groupBy("ward", "fold").agg(F.sum(F.round(F.col("price") * 100).cast("long")).alias("s"), F.count("*").alias("n"))  # cents, so that sums are exact
    others = cells.groupBy("ward").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n")).join(cells, "ward").select("ward", "fold", ((F.col("all_s") - F.col("s")) / (100 * (F.col("all_n") - F.col("n")))).alias("predicted"))
    return rows.join(F.broadcast(others), ["ward", "fold"]).withColumns({"low": 0.5 * F.col("predicted"), "high": 1.6 * F.col("predicted")})


_KEYED = "(SELECT *, 'all' AS level, 'all' AS key FROM p UNION ALL SELECT *, 'branch', segment FROM p UNION ALL SELECT *, 'district', segment || ' / ' || district FROM p UNION ALL SELECT *, 'ward', segment || ' / ' || district || ' / ' || ward FROM p)"


@query(f"""WITH {OUT_OF_FOLD}, k AS (SELECT *, 100 * abs(predicted - price) / price AS e, 100 * (high - low) / 2 / price AS w FROM {_KEYED} WHERE key IS NOT NULL AND predicted IS NOT NULL),
f AS (SELECT level, key, stddev_pop(m) AS mape_sd FROM (SELECT level, key, fold, avg(e) AS m FROM k GROUP BY ALL) GROUP BY ALL)
SELECT level, key, n, round(mape, 4) AS mape, round(mape_sd, 4) AS mape_sd, round(mae, 4) AS mae, round(r2, 4) + 0.0 AS r2, round(within_10, 4) AS within_10, round(within_20, 4) AS within_20, round(covered, 4) AS covered, below, inside, above, round(median_error, 4) AS median_error, round(median_width, 4) AS median_width
FROM (SELECT level, key, count(*) AS n, avg(e) AS mape, avg(abs(predicted - price)) AS mae, CASE WHEN count(DISTINCT price) > 1 THEN 1 - sum(pow(predicted - price, 2)) / (var_pop(price) * count(*)) END AS r2, 100 * avg((e <= 10)::INT) AS within_10, 100 * avg((e <= 20)::INT) AS within_20,
  100 * avg((price BETWEEN low AND high)::INT) AS covered, count(*) FILTER (price < low) AS below, count(*) FILTER (price BETWEEN low AND high) AS inside, count(*) FILTER (price > high) AS above, quantile_cont(e, 0.5) AS median_error, quantile_cont(w, 0.5) AS median_width FROM k GROUP BY ALL HAVING count(*) >= 5)
JOIN f USING (level, key)""")
def metrics_report(spark: SparkSession, d: str) -> DataFrame:
    """Errors, fit, coverage and positions by branch, district and ward of an out-of-fold table of ward means."""
    return rounded(report.metrics_report(_priced(spark, d), LEVELS).where("n >= 5"))


@query(f"""WITH {OUT_OF_FOLD}, w AS (SELECT segment, ward, count(*) AS n FROM p GROUP BY ALL), z AS (SELECT segment, count(*) AS twins, 100 * avg(cv) AS noise FROM (
  SELECT segment, ward, rooms, floor(area / 10) AS b, stddev_samp(price) / avg(price) AS cv FROM p GROUP BY ALL HAVING count(*) >= 2) GROUP BY segment)
SELECT p.segment, count(*) AS rows, round(100 * avg((coalesce(rooms, 0) > 0)::INT), 4) AS precise, any_value(wards) AS wards, any_value(w20) AS wards_20, any_value(w30) AS wards_under_30, any_value(w10) AS wards_under_10, any_value(twins) AS twins, round(any_value(noise), 4) AS noise,
  round(100 * avg(abs(predicted - price) / price), 4) AS mape, round(100 * avg(abs(predicted - price) / price) - any_value(noise), 4) AS gap
FROM p JOIN (SELECT segment, count(*) AS wards, count(*) FILTER (n >= 20) AS w20, count(*) FILTER (n < 30) AS w30, count(*) FILTER (n < 10) AS w10 FROM w GROUP BY segment) v USING (segment) LEFT JOIN z USING (segment) GROUP BY p.segment""")
def branch_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report of each branch: rows, wards, noise floor, errors and the gap between both."""
    priced = _priced(spark, d)
    rates = report.metrics_report(priced, {"branch": ["segment"]})
    out = report.branch_report(priced, rates, "segment", ["ward", "rooms", F.floor(F.col("area") / 10)], precise=F.col("rooms") > 0)
    return rounded(out.drop("r2", "covered"))


@query(f"""WITH {OUT_OF_FOLD} SELECT row_id, fold, floor(predicted)::BIGINT AS predicted, round(100 * (price / predicted - 1), 4) AS deviation, CASE WHEN price < low THEN 'below' WHEN price > high THEN 'above' ELSE 'inside' END AS position FROM p""")
def out_of_fold_table(spark: SparkSession, d: str) -> DataFrame:
    """Every listing with its out-of-fold prediction (whole units), deviation and position."""
    return position(_priced(spark, d)).select("row_id", "fold", F.floor("predicted").alias("predicted"), F.round("deviation", 4).alias("deviation"), "position")


_TWO = """SELECT {keys} n, {b} AS b, sqrt(greatest(yy - ({b}) * xy - ({a}) * wy, 0) / {freedom} * ww / (xx * ww - xw * xw)) AS e FROM m"""
_B, _A = "(xy * ww - wy * xw) / (xx * ww - xw * xw)", "(wy * xx - xy * xw) / (xx * ww - xw * xw)"
_ROWS = f"{LISTING}, r AS (SELECT *, ln(price / area) AS y, (owner % 50)::DOUBLE AS x, ln(area) AS w FROM listing WHERE price > 0)"


@query(f"""WITH {_ROWS}, m AS (SELECT district, count(*) AS n, regr_sxx(x, x) AS xx, regr_sxx(w, w) AS ww, regr_sxx(y, y) AS yy, regr_sxy(x, w) AS xw, regr_sxy(x, y) AS xy, regr_sxy(w, y) AS wy FROM r GROUP BY district)
SELECT district, n, round(b, 9) + 0.0 AS coefficient, round(e, 9) AS error, round(b / e, 4) + 0.0 AS t FROM ({_TWO.format(keys="district,", b=_B, a=_A, freedom="(n - 3)")})""")
def page_depth(spark: SparkSession, d: str) -> DataFrame:
    """How prices per area change with the result page, at equal area, by district."""
    rows = listing(spark, d).where("price > 0")
    out = regression.least_squares(rows, F.log(F.col("price") / F.col("area")), {"page": F.col("owner") % 50, "area": F.log("area")}, ["district"]).where("name = 'page'")
    return out.select("district", "n", F.round("coefficient", 9).alias("coefficient"), F.round("error", 9).alias("error"), F.round("t", 4).alias("t"))


@query(f"""WITH {_ROWS}, g AS (SELECT ward, segment, count(*) AS n, regr_sxx(x, x) AS xx, regr_sxx(w, w) AS ww, regr_sxx(y, y) AS yy, regr_sxy(x, w) AS xw, regr_sxy(x, y) AS xy, regr_sxy(w, y) AS wy FROM r GROUP BY ward, segment),
m AS (SELECT sum(n)::BIGINT AS n, count(*) AS cells, sum(xx) AS xx, sum(ww) AS ww, sum(yy) AS yy, sum(xw) AS xw, sum(xy) AS xy, sum(wy) AS wy FROM g)
SELECT n, round(b, 9) + 0.0 AS coefficient, round(e, 9) AS error FROM ({_TWO.format(keys="", b=_B, a=_A, freedom="(n - 2 - cells)")})""")
def page_depth_within(spark: SparkSession, d: str) -> DataFrame:
    """The same over all rows, with an intercept for each ward and segment."""
    rows = listing(spark, d).where("price > 0")
    out = regression.least_squares(rows, F.log(F.col("price") / F.col("area")), {"page": F.col("owner") % 50, "area": F.log("area")}, effects=["ward", "segment"]).where("name = 'page'")
    return out.select("n", F.round("coefficient", 9).alias("coefficient"), F.round("error", 9).alias("error"))
