"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from sieveyard.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.oracles():
        cur = con.execute(registry.oracles()[name])
        columns = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows(columns, cur.fetchall())
    else:
        assert got
