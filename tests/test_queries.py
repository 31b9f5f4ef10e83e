"""Every registered query runs, and agrees with its SQL where it has some."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from parchment.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    if name not in registry.SQL:
        assert got
        return
    duck.execute(f"CREATE OR REPLACE TEMP VIEW answer AS {registry.SQL[name]}")
    assert sorted(c[0] for c in duck.execute("DESCRIBE answer").fetchall()) == columns
    want = ordered(duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM answer").fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
