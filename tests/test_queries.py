"""Queries of the catalogue against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return f"{v + 0.0:.5g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["seg_props", "box_intersections", "clamped_percentile", "evoked_left", "rag_edges", "graph_block_edges", "knn", "per_class_scores", "stratified_split", "operator_chain", "downsample_mode", "multi_grid_index", "gaussian_filter", "clahe", "local_rank", "percentile_filter", "interpolate_axis", "peak_filter", "label_chunks", "stored_range_read", "materialized_run", "subvolume_process", "closest_segment_points", "cross_modal_distance", "gray_augment", "padded_batches", "box_from_json", "ranking_metrics", "balanced_classes", "distance_map", "watershed_expand", "erode_radius", "warp_linear", "stored_box_read", "box_neighbours", "dimension_correlation", "kebab_names", "spanning_tree", "farthest_point_sampling", "lowpass"])
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want


def test_contract(spark):
    assert set(catalog.ORACLES) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
