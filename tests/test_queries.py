"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

from spectraloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def rows(found):
    return sorted(tuple("null" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    got = registry.QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    expected = con.sql(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]})").fetchall()
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(expected)
