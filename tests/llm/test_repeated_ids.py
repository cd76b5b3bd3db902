"""keep_one on tables with repeated ids."""

from collections import Counter

from gridloom.llm.jaccard import keep_one


def test_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    near, other, third = base + " x", " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    docs = [(1, base), (5, near), (5, other), (7, third), (7, third), (8, third), (9, ""), (9, ""), (None, base), (None, base)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id bigint, text string, n int").repartition(3)
    out = keep_one(df)
    assert out.columns == df.columns
    # the text of its own under id 5 stays, and one row of the exact copies under 7 and 8
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, base), (5, other), (7, third), (9, ""), (9, ""), (None, base), (None, base)])
