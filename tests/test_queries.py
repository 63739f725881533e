"""Every query with SQL equals it; the others run."""

from pathlib import Path

import duckdb
import pytest

from assayfold.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(row):
    return tuple(None if v is None else round(float(v), 7) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    if name in registry.oracle_sql():
        sql = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in sql.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted((plain(r[c] for c in columns) for r in rows), key=repr) == sorted(map(plain, sql.fetchall()), key=repr)
    else:
        assert rows
