"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("-" if v is None else str(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, oracle, name):
    df = entry.queries()[name](spark, FOLDER)
    relation = oracle.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in relation.fetchall()]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain(expected)


def test_entry_renders_documents(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.doc.startswith("<?xml") and r.doc.endswith("</rss>") for r in rows)
    assert all(r.etag.startswith('"') and len(r.etag) == 66 for r in rows)


def test_every_query_has_an_oracle():
    assert set(entry.catalog.QUERIES) == set(entry.catalog.ORACLES)
