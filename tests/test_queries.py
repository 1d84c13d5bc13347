"""Every query that has SQL gives the rows of its SQL in DuckDB, on the smallest tables; the others give rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from grainmill.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_query(spark, db, key):
    df = registry.queries()[key](spark, SF)
    names = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    if key not in SQL:
        assert rows
        return
    got = db.execute(SQL[key])
    order = [d[0] for d in got.description]
    assert sorted(order) == names
    assert rows == Counter(tuple(plain(r[order.index(c)]) for c in names) for r in got.fetchall())
