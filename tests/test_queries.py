"""Each query with SQL gives what DuckDB gives for it."""

from __future__ import annotations

import duckdb
import pytest

from regionlink.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    as_rows = lambda rows: sorted(rows, key=repr)
    assert as_rows(tuple(r[c] for c in columns) for r in found.collect()) == as_rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_map_of_large_values(spark, sf, con, tmp_path):
    """Sums from ten million up, which Spark would write with an exponent."""
    from regionlink.plans.file_queries import map_file

    for t in ("region", "nation"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    con.sql(f"COPY (SELECT * REPLACE (c_acctbal * 10000 AS c_acctbal) FROM '{sf}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    large = duckdb.connect()
    for t in ("region", "nation", "customer"):
        large.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = large.sql(SQL["map_file"]).select("place, line").fetchall()
    assert any("M</title>" in line for _, line in want)
    assert sorted(tuple(r) for r in map_file(spark, str(tmp_path)).collect()) == sorted(want)
