"""Every query of the reference operators runs, and equals its SQL where it has one."""

import duckdb
import pytest

from loomfield.plans import registry
from loomfield.plans.fixtures import TABLES


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.isoformat() if hasattr(x, "isoformat") else x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(small_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    statement = registry.oracle_sql().get(name)
    if statement:
        cursor = duck.execute(statement)
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(df.columns, rows) == canonical(columns, cursor.fetchall())
