"""Every reference query with SQL gives the SQL's rows."""

import datetime as dt

import duckdb
import pytest

import placard.catalog_feeds
import placard.catalog_rules
import placard.catalog_texts  # noqa: F401  (these add their queries)
from placard.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) else int(value) if hasattr(value, "as_tuple") else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    want = sql.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_pages_join_up_to_the_whole_list(spark):
    from placard.catalog import _view
    from placard.plans.views import keyset_page

    view = _view(spark, SF).cache()
    whole = [r.id for r in keyset_page(view, size=10_000).collect()]
    got, after = [], None
    while True:
        page = keyset_page(view, after, size=17).collect()
        got += [r.id for r in page]
        if len(page) < 17:
            break
        assert isinstance(page[-1].registered_on, dt.date)
        after = (page[-1].registered_on.isoformat(), page[-1].id)
    assert got == whole
