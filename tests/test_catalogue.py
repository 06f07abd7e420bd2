"""Every registered query of the library's own operators against its SQL twin, at the smallest scale that has rows."""

import math
import os

import duckdb
import pytest

from cadastra.plans import catalogue, cycle, evidence  # noqa: F401  they add their queries to the catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


#: The queries of the whole cycle have long plans: they run on the smallest tables.
SMALL = SF.replace("sf0.01", "sf0.001")
CYCLE = {name for name, fn in catalogue.QUERIES.items() if fn.__module__ == cycle.__name__}


@pytest.fixture(scope="module")
def ducks():
    found = {}
    for folder in (SF, SMALL):
        found[folder] = duckdb.connect()
        for name in sorted(os.listdir(folder)):
            found[folder].execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return found


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


def same_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, ducks, name):
    folder = SMALL if name in CYCLE else SF
    df = catalogue.QUERIES[name](spark, folder)
    found = ducks[folder].execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    rows = found.fetchall()
    assert rows or folder == SMALL
    assert same_rows(df.columns, df.collect()) == same_rows(columns, rows)
