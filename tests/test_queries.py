"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from beaconry import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that may well find nothing in the smallest tables.
MAY_BE_EMPTY = {"j22_near_pairs"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return None if value is None else round(value, 6) + 0.0 if isinstance(value, float) else int(value) if isinstance(value, bool) else str(value)


def test_every_query_has_its_sql_or_is_known_to_have_none():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    out = registry.queries()[name](spark, SF)
    columns = sorted(out.columns)
    ours = sorted(repr(tuple(map(plain, r))) for r in out.select(*columns).collect())
    assert ours or name in MAY_BE_EMPTY
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    got = duck.execute(sql)
    theirs = [d[0] for d in got.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
