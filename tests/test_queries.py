"""Every registered query with SQL gives the SQL's rows; the others give rows of a stable schema."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from hearthline.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        return None if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(repr([plain(getattr(v, "item", lambda v=v: v)() if not isinstance(v, pd.Timestamp) else v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, db, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), db.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


COLUMNS = {
    "similar_texts": [("row_id", "string"), ("leader", "string")], "page_text": [("page_id", "bigint"), ("title", "string"), ("text", "string")],
    "forest_quantiles": [("row_id", "bigint"), ("q05", "double"), ("q50", "double"), ("q95", "double")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_without_sql(spark, name):
    out = plans.QUERIES[name](spark, SF)
    assert out.dtypes == COLUMNS[name]
    found = out.toPandas()
    assert len(found) > 0 and found[COLUMNS[name][0][0]].is_unique
    if name == "similar_texts":
        assert set(found[found.row_id == found.leader].leader) == set(found.leader)  # a leader leads itself
    elif name == "page_text":
        assert not found.text.str.contains("<script|</").any() and found.title.notna().any()
    else:
        assert ((found.q05 <= found.q50) & (found.q50 <= found.q95)).all()


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() >= 0
