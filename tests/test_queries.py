"""Every query of the engine against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from worldstate.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    cols = sorted(df.columns)
    value = lambda v: None if pd.isna(v) else str(int(v)) if isinstance(v, (int, float)) and float(v).is_integer() else str(v)
    return cols, sorted((tuple(value(v) for v in row) for row in df[cols].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    found = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        assert plain(found) == plain(sql.execute(registry.oracle_sql()[name]).df())
    else:
        assert len(found.columns)
