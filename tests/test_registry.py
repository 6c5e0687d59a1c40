"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from mixlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cells(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else x if isinstance(x, str) else round(float(x), 9) + 0.0
    return sorted(map(repr, (tuple(map(plain, r)) for r in frame.itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_and_sql_agree(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def test_entry(spark):
    assert registry.entry(spark).count() == 1500


@pytest.mark.parametrize("name", ["smc_fit", "hyper_fit"])
def test_fits_assign_every_order(spark, duck, name):
    rows = registry.queries()[name](spark, SF).groupBy("particle").sum("n").collect()
    assert {r[1] for r in rows} == {duck.sql("select count(*) from orders").fetchall()[0][0]}
