"""Every registered query of the vector engine against its SQL in DuckDB."""

import duckdb
import pytest

from zetamill.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
