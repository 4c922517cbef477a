import glob
import os

import pytest

from docframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, oracle, name):
    got = catalogue.queries()[name](spark, SF)
    cur = oracle.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    spell = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert spell(got.select(*columns).collect()) == spell(cur.fetchall())
