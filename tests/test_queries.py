"""Every query of the library against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from docstruct.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)


def test_terms_of_long_texts_at_the_ends_of_texts(spark, tmp_path):
    """The SQL counts no whole word that ends a text; terms that begin with a sign count there."""
    texts = ["the", "x of the", "the the", "the, der", "thethe", "caf é", "é", "los ", "the los ", "a | ", "- -", "the\n", "of THE", "", "the" * 100 + " the", "x" * 253 + "the", "y" * 252 + " the"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = catalog.queries()["t1_terms_of_long_texts"](spark, str(tmp_path)).select("doc_id", "term", "n", "pos").collect()
    want = con.execute(f"SELECT doc_id, term, n, pos FROM ({catalog.oracle_sql()['t1_terms_of_long_texts']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
