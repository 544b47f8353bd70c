import glob
import os

import duckdb
import pytest

from skylattice.plans import queries as sky

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are absent")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def as_number(v):
    """Texts that are no numbers stand for themselves by their bytes."""
    if v is None:
        return None
    try:
        return float(v)
    except ValueError:
        return float(int.from_bytes(str(v).encode()[:16].ljust(16), "big"))


@pytest.mark.parametrize("name", sorted(sky.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = sky.queries()[name](spark, SF).toPandas()
    want = db.execute(sky.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    key = lambda rs: sorted(rs, key=lambda r: tuple((v is None, v or 0) for v in r))
    a = [tuple(as_number(v) for v in r) for r in got[names].astype(object).where(got[names].notna(), None).itertuples(index=False)]
    b = [tuple(as_number(v) for v in r) for r in want[names].astype(object).where(want[names].notna(), None).itertuples(index=False)]
    assert len(a) == len(b) > 0
    for x, y in zip(key(a), key(b), strict=True):
        assert [v is None for v in x] == [v is None for v in y]
        assert [v for v in x if v is not None] == pytest.approx([v for v in y if v is not None], abs=2e-6, nan_ok=True)


@pytest.mark.parametrize("name", [f.__name__ for f in sky.UNCHECKED])
def test_query_runs(spark, name):
    assert sky.queries()[name](spark, SF).count() > 0
