"""Every raster query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from voxelframe import chunk_queries, operator_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want)
    assert sorted(got) == cols
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        assert (got[c].to_numpy() == want[c].to_numpy()).all(), c
