"""Queries whose SQL once held only for small tables, against it on a longer volume."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401 registers the queries
from gridloom.plans import catalog


def rows(table):
    """Rows of either engine, the sign of a zero kept."""
    return sorted(repr(tuple(list(v) if isinstance(v, list | tuple) else v for v in r)) for r in table)


def both(spark, tmp_path, name, tables):
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(catalog.ORACLES[name])
    at = [[d[0] for d in want.description].index(c) for c in df.columns]
    return rows(tuple(r) for r in df.collect()), rows(tuple(r[i] for i in at) for r in want.fetchall())


#: 45 planes of 20 x 20 voxels.
EVENTS = "SELECT i AS event_id, ['error', 'click', 'view'][i % 3 + 1] AS event_type, (i * 7 % 50) / 2.0::DOUBLE AS value, (i * 31) % 23 AS user_id FROM range(18000) r(i)"


#: Few edges, most of them between users of one block.
LINES = "SELECT i % 40 AS l_partkey, i % 7 AS l_suppkey, CAST(i % 50 AS DOUBLE) AS l_quantity FROM range(200) r(i)"


@pytest.mark.parametrize("name", ["boundary_mask"])
def test_volume_queries_hold_on_more_planes(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, {"events": EVENTS})
    assert got == want


def test_a_voxel_of_value_0_is_empty_whatever_its_label(spark, tmp_path):
    got, want = both(spark, tmp_path, "merge_where_empty", {"events": EVENTS})
    assert got == want


@pytest.mark.parametrize("name", ["graph_pcg_ids", "graph_block_neighbours", "graph_block_edges", "graph_dropped", "graph_components"])
def test_graph_queries_hold_on_more_planes(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, {"events": EVENTS, "lineitem": LINES})
    assert got == want


def test_a_value_that_rounds_to_0_has_no_sign(spark, tmp_path):
    vectors = "SELECT 1 AS vec_id, [-0.5, 0.5, -1e-7, 1e-7]::FLOAT[] AS embedding"
    got, want = both(spark, tmp_path, "instance_norm", {"embeddings": vectors})
    assert got == want
