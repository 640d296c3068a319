"""Every registered query of the library runs at the smallest scale and agrees with its SQL."""

import os

import duckdb
import pytest

from folium import queries as library

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def canonical(rows):
    show = lambda v: "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, con, name):
    df = library.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    sql = library.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert canonical(got) == canonical(expected)
