"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from evidentia.plans.oracle import ORACLE
from evidentia.plans.queries import REGISTERED

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(float(v), 6) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query(spark, con, name):
    df = REGISTERED[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert shown(df.columns, rows) == shown(columns, cur.fetchall())
