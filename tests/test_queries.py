"""Every query of the library against DuckDB on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tracewell import plans


def canonical(rows, names):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v) + 0.0, 7) if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def views(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, data, views, name):
    got = entry.queries()[name](spark, data)
    want = views.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_every_query_has_an_oracle():
    assert set(plans.ORACLES) == set(plans.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
