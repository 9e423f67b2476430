"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

from lacuna.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def rows(df):
    cols, plain = sorted(df.columns), lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return cols, sorted(repr(tuple(map(plain, r))) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, SMALL).toPandas()) == rows(db.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
