"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from weftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(duck.execute(f"select {names} from ({registry.oracle_sql()[name]})").fetchall(), key=repr)
    assert got == want
