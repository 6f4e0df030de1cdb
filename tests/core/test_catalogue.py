"""Every query of the catalogue runs over the smallest tables, gives rows, and equals its oracle."""

import glob
import os

import duckdb
import pytest

from spanloom.operators import chunking
from spanloom.plans import catalogue, further, more, reading, streams, whole  # noqa: F401

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"stale_indexes"}


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = sorted(tuple(plain(v) for v in r) for r in df.collect())
    assert rows or name in MAY_BE_EMPTY
    sql = catalogue.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        assert [d[0] for d in found.description] == df.columns
        assert sorted(tuple(plain(v) for v in r) for r in found.fetchall()) == rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_spoken_texts_are_the_folds(spark):
    """The column expression and the function that folds need give the same."""
    text = {r.doc_id: r.text for r in catalogue.documents(spark, SF).collect()}
    for r in catalogue.queries()["sanitize_text"](spark, SF).collect():
        t = text[r.doc_id]
        assert r.out == (None if t is None else chunking.spoken(f"1.2 {t}\n12\n-----\nThe U.K. and NATO MPs met… at 9 . then"))
