"""Every registered query with SQL of its own gives that SQL's rows."""

import math
import os

import pytest

from plumbline.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, FOLDER)
    held = oracle.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in held.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(held.fetchall(), columns)


def test_the_flagship_finds_repeated_rows(spark):
    rows = catalogue.flagship(spark, FOLDER).collect()
    assert rows and all(r["mechanism"] == "multiplicity" and r["set_reading"] == 1 for r in rows)
