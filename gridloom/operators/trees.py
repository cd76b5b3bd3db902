"""Biconnected parts of graphs, objects within objects, and cuts of trees, by the numbers of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.tours import numbered, rooted, spanning_forest, subtree_extremes, subtree_sums
from gridloom.sources.shared import materialized


def _plain(edges: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """(ids: graph, node, id over all graphs; a, b: distinct edges between ids)."""
    once = edges.where(f"a <> b AND {graph} IS NOT NULL").select(graph, F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).distinct()
    once = materialized(once, "edges")
    nodes = once.select(graph, F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = materialized(numbered(nodes, graph, "node", name="id"), "ids")
    at = lambda c: ids.select(graph, F.col("node").alias(c), F.col("id").alias(f"_{c}"))
    return ids, materialized(once.join(at("a"), [graph, "a"]).join(at("b"), [graph, "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b")), "plain")


def biconnected(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, component, a, b: the edges (a < b) of each graph by biconnected component, numbered by their least edges.

    On a spanning tree with depth-first numbers, two tree edges are linked if
    an edge outside of the tree joins two branches, or leads from below an edge
    to outside of the tree under its upper end; parts of linked edges are the
    components. Loops and repeated edges count once or not; rows with a null
    are left out. No graph is gathered: all steps are joins on nodes.
    """
    kind = edges.schema[graph].dataType.simpleString()
    ids, plain = _plain(edges.dropna(subset=[graph, "a", "b"]), graph)
    if plain.isEmpty():
        return edges.sparkSession.createDataFrame([], f"{graph} {kind}, component int, a bigint, b bigint")
    forest, labels = spanning_forest(plain)
    tree = rooted(forest, labels.select("node", F.col("component").alias("root")))
    other = materialized(plain.join(forest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "others")
    place = lambda c: tree.select(F.col("node").alias(c), F.col("pre").alias(f"p{c}"), F.col("size").alias(f"s{c}"))
    other = materialized(other.join(place("a"), "a").join(place("b"), "b"), "others")
    reach = other.select(F.col("a").alias("node"), F.col("pb").alias("p")).unionByName(other.select(F.col("b").alias("node"), F.col("pa").alias("p"))).groupBy("node").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    values = tree.join(reach, "node", "left").select("node", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high"))
    extremes = subtree_extremes(tree, values)
    first = F.col("pa") < F.col("pb")
    u, w = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    end_u = F.when(first, F.col("pa") + F.col("sa")).otherwise(F.col("pb") + F.col("sb"))
    across = other.where(end_u <= F.greatest("pa", "pb")).select(u.alias("a"), w.alias("b"))
    above = tree.select(F.col("node").alias("parent"), F.col("pre").alias("pp"), F.col("size").alias("ps"), F.col("parent").alias("grand"))
    under = tree.where("parent IS NOT NULL").join(extremes, "node").join(above, "parent").where("grand IS NOT NULL AND (low < pp OR high >= pp + ps)")
    linked = across.unionByName(under.select(F.col("parent").alias("a"), F.col("node").alias("b")))
    _, parts = spanning_forest(materialized(linked, "linked"))
    upper = tree.where("parent IS NOT NULL").select("node", "parent")
    part_of = materialized(upper.join(parts, "node", "left").select("node", "parent", F.coalesce("component", "node").alias("part")), "parts")
    mine = part_of.select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"), "part")
    rest = other.select("a", "b", w.alias("node")).join(part_of.select("node", "part"), "node").select("a", "b", "part")
    back = lambda c: ids.select(graph, F.col("id").alias(c), F.col("node").alias(f"_{c}"))
    named = mine.unionByName(rest).join(back("a"), "a").join(back("b").drop(graph), "b").select(graph, "part", F.col("_a").alias("a"), F.col("_b").alias("b"))
    named = materialized(named, "named")
    least = named.groupBy(graph, "part").agg(F.min(F.struct("a", "b")).alias("e")).select(graph, "part", "e.a", "e.b")
    order = materialized(numbered(least, graph, "a", "b").select(graph, "part", "n"), "order")
    start = order.groupBy(graph).agg(F.min("n").alias("first"))
    numbers = order.join(start, graph).select(graph, "part", (F.col("n") - F.col("first")).cast("int").alias("component"))
    return named.join(numbers, [graph, "part"]).select(graph, "component", "a", "b")


def articulation_points(components: DataFrame, graph: str = "graph") -> DataFrame:
    """Nodes in two biconnected components or more."""
    ends = components.select(graph, "component", F.explode(F.array("a", "b")).alias("node")).distinct()
    return ends.groupBy(graph, "node").agg(F.count("*").alias("n")).where("n > 1").select(graph, "node")


def internal_objects(components: DataFrame, outer: DataFrame | None = None, graph: str = "graph") -> DataFrame:
    """graph, component, target: components of a region graph that lie wholly within one object, and the articulation point they merge into.

    ``components`` is that of :func:`biconnected`; those with a node of
    ``outer`` (graph, node), such as the background or labels on the border,
    are never internal. Components and articulation points form trees. Each is
    rooted at the least of its components that are not internal; a component
    without any such below it merges into the point above it, and on into the
    point above that as long as the component between merges too. A tree
    without any component of ``outer`` merges into its least point as a whole.
    """
    components = materialized(components.select(graph, "component", "a", "b"), "components")
    kind = components.schema[graph].dataType.simpleString()
    ends = components.select(graph, "component", F.explode(F.array("a", "b")).alias("node")).distinct()
    joints = materialized(ends.join(articulation_points(components, graph), [graph, "node"]), "joints")
    if joints.isEmpty():
        return components.sparkSession.createDataFrame([], f"{graph} {kind}, component int, target bigint")
    # both kinds of nodes under one number: points first
    both = joints.select(graph, F.lit(0).alias("is_block"), F.col("node").alias("what")).unionByName(joints.select(graph, F.lit(1).alias("is_block"), F.col("component").cast("bigint").alias("what"))).distinct()
    ids = materialized(numbered(both, graph, "is_block", "what", name="id"), "ids")
    points = ids.where("is_block = 0").select(graph, F.col("what").alias("node"), F.col("id").alias("a"))
    blocks = ids.where("is_block = 1").select(graph, F.col("what").cast("int").alias("component"), F.col("id").alias("b"))
    forest = materialized(joints.join(points, [graph, "node"]).join(blocks, [graph, "component"]).select("a", "b"), "forest")
    _, labels = spanning_forest(forest)
    if outer is None:
        fixed = blocks.select("b").limit(0)
    else:
        fixed = ends.join(outer.select(graph, "node").distinct(), [graph, "node"], "left_semi").select(graph, "component").distinct().join(blocks, [graph, "component"]).select("b")
    fixed = materialized(fixed.select(F.col("b").alias("node"), F.lit(1).cast("bigint").alias("v")), "fixed")
    roots = labels.join(fixed, "node", "left").groupBy("component").agg(F.coalesce(F.min(F.when(F.col("v") == 1, F.col("node"))), F.min("node")).alias("root"))
    nodes = materialized(labels.join(roots, "component").select("node", "root"), "nodes")
    tree = rooted(forest, nodes)
    held = subtree_sums(tree, fixed).select("node", F.lit(True).alias("held"))
    merging = tree.join(ids.where("is_block = 1").select(F.col("id").alias("node")), "node", "left_semi").join(held, "node", "left").where("held IS NULL AND parent IS NOT NULL")
    merging = materialized(merging.select("node", "parent"), "merging")
    # a point leads on to the one above it if the component between merges
    point = tree.select(F.col("node").alias("point"), F.col("parent").alias("block"))
    chain = point.join(merging.select(F.col("node").alias("block"), F.col("parent").alias("to")), "block").select("point", "to")
    chain = materialized(chain, "chain")
    while True:
        ahead = chain.select(F.col("point").alias("_p"), F.col("to").alias("_to"))
        moved = materialized(chain.join(ahead, F.col("to") == F.col("_p"), "left").select("point", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "chain")
        chain = moved.select("point", "to")
        if moved.where("moved").isEmpty():
            break
    last = merging.join(chain, F.col("parent") == F.col("point"), "left").select(F.col("node").alias("b"), F.coalesce("to", "parent").alias("a"))
    return last.join(blocks, "b").join(points.drop(graph), "a").select(graph, "component", F.col("node").alias("target"))


def best_cut(edges: DataFrame, labels: DataFrame, graph: str = "graph") -> DataFrame:
    """The tree edge whose removal leaves the two most consistent parts: graph, a, b, consistency, initial.

    The consistency of a part is the weight of its largest class; ``initial`` is
    that of the whole tree. ``labels`` has graph, node and either ``label`` or
    ``vector`` (a weight for each class; of unequal lengths the missing ones
    are 0). Of equal cuts the least edge is taken. A graph with a cycle or in
    several parts is an error. Sums below each edge come from depth-first
    numbers, by class, so a tree of any size is no one's group.
    """
    ids, plain = _plain(edges.dropna(subset=[graph, "a", "b"]), graph)
    kind = edges.schema[graph].dataType.simpleString()
    if plain.isEmpty():
        return edges.sparkSession.createDataFrame([], f"{graph} {kind}, a bigint, b bigint, consistency double, initial double")
    forest, parts = spanning_forest(plain)
    counts = ids.groupBy(graph).agg(F.count("*").alias("nodes"))
    owner = ids.select(graph, F.col("id").alias("a"))
    lines = plain.join(owner, "a").groupBy(graph).agg(F.count("*").alias("lines"))
    bad = counts.join(lines, graph).where("lines <> nodes - 1").unionByName(ids.join(parts, ids["id"] == parts["node"]).groupBy(graph).agg(F.countDistinct("component").alias("nodes")).where("nodes > 1").withColumn("lines", F.lit(0)))
    if not bad.isEmpty():
        raise ValueError("the graph is not a tree")
    tree = rooted(forest, parts.select("node", F.col("component").alias("root")))
    if "vector" in labels.columns:
        weights = labels.select(graph, F.col("node").alias("_node"), F.posexplode("vector").alias("class", "v")).select(graph, "_node", F.col("class").cast("string").alias("class"), F.col("v").cast("double").alias("v"))
    else:
        weights = labels.where("label IS NOT NULL").select(graph, F.col("node").alias("_node"), F.col("label").cast("string").alias("class"), F.lit(1.0).alias("v"))
    values = materialized(weights.join(ids.withColumnRenamed("node", "_node"), [graph, "_node"]).select(F.col("id").alias("node"), "class", "v"), "weights")
    below = subtree_sums(tree, values, "class")
    total = values.join(tree.select("node", "root"), "node").groupBy("root", "class").agg(F.sum("v").alias("total"))
    # for each node and class of its tree: what is below it, and what is left
    side = tree.select("node", "root").join(total, "root").join(below, ["node", "class"], "left")
    most = side.groupBy("node").agg(F.max(F.coalesce("below", F.lit(0.0))).alias("inner"), F.max(F.col("total") - F.coalesce("below", F.lit(0.0))).alias("rest"))
    initial = total.groupBy("root").agg(F.max("total").alias("initial"))
    name = lambda c: ids.select(graph, F.col("id").alias(c), F.col("node").alias(f"_{c}"))
    cut = tree.where("parent IS NOT NULL").join(most, "node", "left").join(initial, "root", "left").join(name("node"), "node").join(name("parent").drop(graph), "parent")
    none = F.lit(0.0)
    cut = cut.select(graph, F.least("_node", "_parent").alias("a"), F.greatest("_node", "_parent").alias("b"), F.round(F.coalesce("inner", none) + F.coalesce("rest", none), 9).alias("consistency"), F.coalesce("initial", none).alias("initial"))
    best = Window.partitionBy(graph).orderBy(F.desc("consistency"), "a", "b")
    return cut.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
