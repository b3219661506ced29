"""Every registered query of the library against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from tarnfold.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_twin(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=key) == sorted(rows, key=key)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["path", "ordinal", "kind", "name", "body", "refs"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
