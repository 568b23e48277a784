"""Every query against its SQL, over the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("VELLUM_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

from vellum.queries.core import QUERIES  # noqa: E402
from vellum.queries.oracle import ORACLE  # noqa: E402


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5) + 0.0
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, database, name):
    got = QUERIES[name](spark, FOLDER)
    relation = database.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
