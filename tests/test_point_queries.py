"""Searches of chosen points among all give what those of all points give for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import points as P

SEARCHES = {"sq_distances": lambda df, **q: P.pair_distances(df, **q), "knn": lambda df, **q: P.knn(df, 3, **q), "ball_query": lambda df, **q: P.ball_query(df, 0.3, 4, **q)}


@pytest.mark.parametrize("name", SEARCHES)
def test_queries_among_all_points(spark, name):
    rng = np.random.default_rng(3)
    at = np.repeat(rng.random((40, 3)), 2, axis=0)  # two points a place
    df = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(at)], "cloud int, idx bigint, x double, y double, z double").cache()
    whole = sorted(tuple(r) for r in SEARCHES[name](df).where("i % 7 = 0").collect())
    assert whole and sorted(tuple(r) for r in SEARCHES[name](df, queries=F.col("idx") % 7 == 0).collect()) == whole
