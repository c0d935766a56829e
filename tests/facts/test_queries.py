"""Every registered query of facts against its SQL."""

import duckdb
import pytest

from factlog.queries import QUERIES, SQL


def rows(df, columns):
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
