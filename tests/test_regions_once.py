"""The voxels of a region graph meet once; what is built on the graph reads the written pairs of labels."""

from gridloom.plans import structure_queries as Q


def test_regions_meet_once(spark):
    graph = Q._regions(spark, "/root/testdata/sf0.001")
    assert "events.parquet" not in graph._jdf.queryExecution().executedPlan().toString()  # before: the voxels again in each step
    assert graph.count() > 0
