"""The registered analyses against DuckDB at the smallest scale."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from quillon import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def told(v):
    return "null" if v is None or v != v else f"{float(v):.4f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def found(spark):
    """All queries' rows, several at a time: each is a few small jobs, which leave most cores idle."""
    queries = catalog.queries()

    def rows(name):
        df = queries[name](spark, SF)
        return sorted(df.columns), [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(rows, name) for name in queries}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(found, duck, name):
    cols, ours = found[name].result()
    ours = sorted([told(v) for v in r] for r in ours)
    sql = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    theirs = sorted([told(r[names.index(c)]) for c in cols] for r in sql.fetchall())
    assert sorted(names) == cols
    if ours != theirs:
        assert [[float(x) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else x for x in r] for r in ours] == [
            [pytest.approx(float(x), abs=2e-4) if x.replace(".", "", 1).replace("-", "", 1).isdigit() else x for x in r] for r in theirs
        ]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(found, name):
    assert found[name].result()[1]
