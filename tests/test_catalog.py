"""Every registered query on small tables against the SQL that must give its rows."""

import decimal

import duckdb
import pytest

from tessera.plans import catalog, scans  # noqa: F401  (registers its queries)

SOURCE = "/root/testdata/sf0.001"
TABLES = "events documents embeddings benchmark lineitem part".split()
SIZES = {"lineitem": "WHERE l_orderkey < 90", "benchmark": "WHERE item_id < 8", "events": "WHERE event_id < 400"}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    place, con = tmp_path_factory.mktemp("small"), duckdb.connect()
    for t in TABLES:
        con.sql(f"COPY (SELECT * FROM '{SOURCE}/{t}.parquet' {SIZES.get(t, '')}) TO '{place}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{place}/{t}.parquet'")
    return str(place), con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    return v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, small, name):
    place, con = small
    df = catalog.QUERIES[name](spark, place)
    columns = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows
    if name in catalog.ORACLE_SQL:
        found = con.sql(catalog.ORACLE_SQL[name])
        names = found.columns
        assert sorted(names) == columns
        expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        assert rows == sorted((tuple(norm(r[c]) for c in columns) for r in expected), key=repr)
