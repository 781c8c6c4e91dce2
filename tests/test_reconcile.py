"""Columns of several types: the type chosen, cells kept, clashes and odd rows."""

import pytest
from pyspark.sql import functions as F

from hearthline.sources import reconcile as rc

ROWS = [
    (1, '{"k": 1, "a.b": 1.50, "n": null, "t": "x", "o": {"z": [1, 2]}, "b": true, "day": "2024-02-29"}'), (2, '{"k": 2, "a.b": 1e3, "t": 7, "day": "2024-01-31"}'),
    (3, "nope"), (4, None), (5, "[1, 2]"), (6, '{"k": 9007199254740993, "big": 12345678901234567890.5}'), (7, "{}"), (8, '{"big": 123456789012345678901234567890123456789012345}'), (9, ""),
    (12, '{"lat": 105.80481919999998}'), (13, '{"lat": 0.1, "far": 105.12345678901234567}'), (10, '{"k": 5, "k": 6}'), (11, '{"a.b": 3, "d": "2023-02-29"}'),
]


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, p string")


def test_types_hold_every_value(rows):
    report = {r["column"]: r for r in rc.column_report(rc.json_kinds(rows, "p")).collect()}
    assert {c: r["type"] for c, r in report.items()} == {"k": "bigint", "a.b": "double", "t": "string", "o": "string", "b": "boolean", "day": "date", "big": "string", "d": "string", "lat": "double", "far": "string"}
    assert report["t"]["kinds"] == "text:1,whole:1" and report["t"]["moved"] == 1 and report["a.b"]["moved"] == 1 and report["k"]["kinds"] == "long:1,whole:2"
    got = {r["id"]: r for r in rc.typed_json(rows, "p", rc.column_types(rc.column_report(rc.json_kinds(rows, "p")))).collect()}
    assert got[6]["k"] == 9007199254740993 and got[6]["big"] == "12345678901234567890.5" and got[8]["big"] == "123456789012345678901234567890123456789012345"
    assert (got[1]["a.b"], got[2]["a.b"], got[11]["a.b"], got[2]["t"], got[1]["o"], got[1]["b"]) == (1.5, 1000.0, 3.0, "7", '{"z":[1,2]}', True)
    assert (got[12]["lat"], got[13]["far"]) == (105.80481919999998, "105.12345678901234567")
    assert [got[i]["unread"] for i in (3, 4, 5, 7, 9, 10)] == ["nope", None, "[1, 2]", None, "", '{"k": 5, "k": 6}']


def test_one_odd_cell_far_down_decides(spark):
    many = spark.range(20_000).select("id", F.when(F.col("id") == 19_999, '{"v": "x"}').otherwise(F.concat(F.lit('{"v": '), F.col("id").cast("string"), F.lit("}"))).alias("p"))
    assert rc.column_types(rc.column_report(rc.json_kinds(many, "p"))) == {"v": "string"}


def test_fractions_without_decimals_are_fractions(spark):
    rows = spark.createDataFrame([('{"v": 37.0, "w": 1}',), ('{"v": 5, "w": 12345678901234567.0}',), ('{"v": -0.0}',)], "p string")
    types = rc.column_types(rc.column_report(rc.json_kinds(rows, "p")))
    assert types == {"v": "double", "w": "string"}
    assert [r["v"] for r in rc.typed_json(rows, "p", types).collect()] == [37.0, 5.0, 0.0]


def test_written_and_read_back(spark, rows, tmp_path):
    types = rc.write_reconciled(rows, "p", f"file://{tmp_path}/t")
    back = spark.read.parquet(f"file://{tmp_path}/t")
    assert dict(back.dtypes) == {"id": "int", **types, "unread": "string"} and back.count() == len(ROWS)
    assert rc.write_reconciled(rows.where("id < 0"), "p", f"file://{tmp_path}/none") == {}
    with pytest.raises(Exception, match="(?i)exist"):
        rc.write_reconciled(rows, "p", f"file://{tmp_path}/t")


def test_clashes_and_too_many_fields_raise(rows):
    with pytest.raises(ValueError, match="columns twice: id"):
        rc.typed_json(rows, "p", {"ID": "string"})
    with pytest.raises(ValueError, match="more than 2"):
        rc.column_types(rc.column_report(rc.json_kinds(rows, "p")), most=2)


def test_text_columns(spark):
    t = spark.createDataFrame([("1", "007", "true", "2024-01-31", "1.50", "", "-0.0"), ("-12", "7", "false", "2024-13-01", "2", None, "0.0"), (None,) * 7], ["a", "b", "c", "d", "e", "f", "g"])
    types = rc.column_types(rc.column_report(rc.text_kinds(t, t.columns)))
    assert types == {"a": "bigint", "b": "string", "c": "boolean", "d": "string", "e": "double", "f": "string", "g": "string"}
    out = rc.typed_text(t, types).collect()
    assert (out[1]["a"], out[0]["b"], out[0]["c"], out[0]["e"], out[0]["f"]) == (-12, "007", True, 1.5, "")
