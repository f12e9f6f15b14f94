"""Every query that SQL can express must agree with DuckDB on the small tables."""

import math

import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from docflow.plans.registry import FLAGSHIP, ORACLES, QUERIES


def rows_of(df: pd.DataFrame) -> list:
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        row = []
        for x in r:
            if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
                row.append(None)
            elif isinstance(x, pd.Timestamp):
                row.append(str(x))
            else:
                x = x.item() if hasattr(x, "item") else x
                row.append(round(float(x), 6) if isinstance(x, float) else x)
        out.append(tuple(row))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert FLAGSHIP in QUERIES
    df = entry.entry(spark)
    assert df.count() > 0 and "uuid" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
