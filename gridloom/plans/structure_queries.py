"""Queries of tree, graph and contrastive operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import contrastive as C
from gridloom.operators import points as P
from gridloom.operators import segmentation as S
from gridloom.operators import trees as T
from gridloom.plans.catalog import query
from gridloom.plans.views import cloud, table, vox
from gridloom.sources.shared import materialized


def _regions(spark, sf_dir):
    touching = S.region_adjacency(vox(spark, sf_dir).withColumn("label", F.col("user_id"))).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    touching = materialized(touching, "touching")  # the voxels meet once; what follows is as large as the labels' pairs
    parts = S.connected(touching).select(F.col("node").alias("a"), F.col("component").alias("graph"))
    return touching.join(parts, "a").select("graph", "a", "b")


query("biconnected_components")(lambda s, d: T.biconnected(_regions(s, d)))
query("articulation_points")(lambda s, d: T.articulation_points(T.biconnected(_regions(s, d))))
query("internal_objects")(lambda s, d: T.internal_objects(T.biconnected(_regions(s, d))))


def _links(spark, sf_dir):
    """Twenty graphs of parts: each leads to one other, and some to a second."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).cast("bigint").alias("graph"), F.expr("p_partkey div 20").alias("a"), F.col("p_size").cast("bigint").alias("s"))
    first = p.select("graph", "a", ((F.col("a") * F.col("a") + F.col("s")) % 97).alias("b"))
    return first.unionByName(p.where("s % 5 = 0").select("graph", "a", ((F.col("a") * 3 + 1) % 97).alias("b")))


_LINKS = """p AS (SELECT p_partkey % 20 AS graph, p_partkey // 20 AS a, CAST(p_size AS BIGINT) AS s FROM part),
e AS (SELECT DISTINCT graph, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT graph, a, (a * a + s) % 97 AS b FROM p UNION ALL SELECT graph, a, (a * 3 + 1) % 97 FROM p WHERE s % 5 = 0) WHERE a <> b),
n AS (SELECT graph, a, b FROM e UNION ALL SELECT graph, b, a FROM e),
reach AS (SELECT graph, a AS r, b AS s, b AS node FROM n UNION SELECT x.graph, x.r, x.s, n.b FROM reach x JOIN n ON n.graph = x.graph AND n.a = x.node WHERE n.b <> x.r),
side AS (SELECT graph, r, s, min(node) AS c FROM reach GROUP BY ALL)"""


@query("link_articulation_points", f"WITH RECURSIVE {_LINKS} SELECT graph, r AS node FROM side GROUP BY graph, r HAVING count(DISTINCT c) > 1")
def link_articulation_points(spark, sf_dir):
    return T.articulation_points(T.biconnected(_links(spark, sf_dir)))


@query("link_components", f"""WITH RECURSIVE {_LINKS},
k AS (SELECT graph, least(r, s) * 1000000 + greatest(r, s) AS edge, r, c FROM side),
met AS (SELECT graph, edge, edge AS other FROM k UNION SELECT m.graph, m.edge, k2.edge FROM met m JOIN k k1 ON k1.graph = m.graph AND k1.edge = m.other JOIN k k2 ON k2.graph = k1.graph AND k2.r = k1.r AND k2.c = k1.c),
least_ AS (SELECT graph, edge, min(other) AS m FROM met GROUP BY ALL)
SELECT graph, CAST(dense_rank() OVER (PARTITION BY graph ORDER BY m) - 1 AS INTEGER) AS component, edge // 1000000 AS a, edge % 1000000 AS b FROM least_""")
def link_components(spark, sf_dir):
    return T.biconnected(_links(spark, sf_dir))


@query("link_internal_objects")
def link_internal_objects(spark, sf_dir):
    links = _links(spark, sf_dir)
    outside = links.where("b % 24 = 0").select("graph", F.col("b").alias("node"))
    return T.internal_objects(T.biconnected(links), outside)


@query("best_tree_cut")
def best_tree_cut(spark, sf_dir):
    points = cloud(spark, sf_dir)
    edges = P.spanning_tree(points).select(F.col("cloud").alias("graph"), F.col("i").alias("a"), F.col("j").alias("b"))
    labels = points.select(F.col("cloud").alias("graph"), F.col("idx").alias("node"), F.when(F.col("x") > 0, 1).otherwise(2).alias("label"))
    return T.best_cut(edges, labels)


_SIM = """e AS (SELECT vec_id // 20 AS batch, vec_id AS idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.batch, a.idx AS i, b.idx AS j, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.batch = b.batch AND a.idx <> b.idx)"""


def _batches(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("batch"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))


_PARTNER = "i + 1 - 2 * (i % 2)"


@query("contrastive_loss", f"WITH {_SIM} SELECT batch, i, round(-ln(sum(CASE WHEN j = {_PARTNER} THEN exp(s / 0.5) END) / sum(exp(s / 0.5))), 5) AS loss FROM s GROUP BY batch, i")
def contrastive_loss(spark, sf_dir):
    return C.nt_xent(_batches(spark, sf_dir), F.expr(_PARTNER), 0.5).withColumn("loss", F.round("loss", 5))


@query("retrieval_accuracy", f"WITH {_SIM}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, i ORDER BY round(s, 9) DESC, j) AS k FROM s) SELECT batch, round(avg(CAST(k <= 1 AS DOUBLE)), 6) AS top1, round(avg(CAST(k <= 5 AS DOUBLE)), 6) AS top5 FROM r WHERE j = {_PARTNER} GROUP BY batch")
def retrieval_accuracy(spark, sf_dir):
    return C.retrieval(_batches(spark, sf_dir), F.expr(_PARTNER)).select("batch", F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


@query("negative_cosine", "SELECT vec_id, round(-list_cosine_similarity(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)), list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))), 6) AS loss FROM embeddings")
def negative_cosine(spark, sf_dir):
    half = lambda k: F.transform(F.slice("embedding", k, 32), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(C.negative_cosine(half(1), half(33)), 6).alias("loss"))
