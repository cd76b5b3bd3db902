"""Short lists of equal members under different keys."""

import pytest

from gridloom.llm.jaccard import _candidates

SPLIT, OFTEN = 1 << 62, 1 << 61


@pytest.mark.parametrize("first, second", [(SPLIT | OFTEN, OFTEN), (SPLIT | OFTEN, 0), (OFTEN, 0), (0, OFTEN)])
def test_a_list_does_not_hide_one_with_more_rights(spark, first, second):
    size = 10 << 31 | 40
    rows = [(key, 0, node, flags | size) for key, flags in ((1, first), (2, second), (3, second)) for node in (11, 12, 13)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = _candidates(spark.createDataFrame(rows, "key bigint, salt int, node bigint, meta bigint"), 75, 16).where("kind = 1").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # each of the rights that may settle pairs stands once, whatever the order of keys
    assert sorted((r["meta"], r["b"]) for r in got) == sorted((f | size, n) for f in {first, second} for n in (11, 12, 13))
