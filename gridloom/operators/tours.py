"""Trees by numbers: spanning forests, Euler tours, orders and subtree sums, as rounds of joins.

No tree is gathered in a task. Every table has a row a node, edge or arc; the
number of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.shared import materialized


def numbered(df: DataFrame, *by: str, name: str = "n", first: int = 0) -> DataFrame:
    """Numbers rows from ``first`` in the order of ``by``: ranges are sorted in parallel and shifted by the sizes of those before."""
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    placed = materialized(placed, "ranges")
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return placed.withColumn("_p", part).join(F.broadcast(shift), "_p").withColumn(name, (place + F.col("_s") + first).cast("bigint")).drop("_p", "_s", "_m")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b of a spanning forest's edges; node, component of all nodes, the least of each).

    In each round every node hangs itself under the neighbour of the least
    hash if that is less than its own; paths are then cut short to their ends,
    which become the nodes of the next round. A constant share of nodes is
    left each time, whatever the graph's diameter.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialized(links.select("a", "b", F.col("a").alias("ea"), F.col("b").alias("eb")), "links")
    nodes = materialized(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("at", F.col("node")), "nodes")
    chosen, turn = None, 0
    while not links.isEmpty():
        key = lambda c, t=turn: F.xxhash64(c, F.lit(t))
        way = lambda b: F.struct(key(b).alias("h"), F.col(b).alias("to"), "ea", "eb")
        both = links.select("a", way("b").alias("w")).unionByName(links.select(F.col("b").alias("a"), way("a").alias("w")))
        hung = both.groupBy("a").agg(F.min("w").alias("w"))
        down = F.struct(F.col("w.h"), F.col("w.to")) < F.struct(key("a"), F.col("a"))
        hung = materialized(hung.select(F.col("a").alias("node"), F.when(down, F.col("w.to")).otherwise(F.col("a")).alias("up"), F.when(down, F.col("w.ea")).alias("ea"), F.when(down, F.col("w.eb")).alias("eb")), "hung")
        picked = hung.where("ea IS NOT NULL").select(F.col("ea").alias("a"), F.col("eb").alias("b"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
        tops = hung.select("node", "up")
        while True:
            above = tops.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            tops = materialized(tops.join(above, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up"), (F.col("_u") != F.col("up")).alias("moved")), "tops")
            if tops.where("moved").isEmpty():
                break
            tops = tops.select("node", "up")
        end = lambda c: tops.select(F.col("node").alias(c), F.col("up").alias(f"_{c}"))
        links = links.join(end("a"), "a").join(end("b"), "b").where("_a <> _b").groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min(F.struct("ea", "eb")).alias("e"))
        links = materialized(links.select("a", "b", "e.ea", "e.eb"), "links")
        nodes = nodes.join(end("at"), "at", "left").select("node", F.coalesce("_at", "at").alias("at"))
        nodes = materialized(nodes, "nodes") if turn % 3 == 2 else nodes  # the plan stays short
        turn += 1
    least = nodes.groupBy("at").agg(F.min("node").alias("component"))
    labels = materialized(nodes.join(least, "at").select("node", "component"), "components")
    return (links.select("a", "b") if chosen is None else materialized(chosen, "forest")), labels


def _doubled(steps: DataFrame) -> DataFrame:
    """Each arc's ``next`` and distance ``d`` by steps twice as long."""
    ahead = steps.select(F.col("n").alias("_n"), F.col("next").alias("_next"), F.col("d").alias("_d"))
    return steps.join(ahead, F.col("next") == F.col("_n"), "left").select("n", F.col("_next").alias("next"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"))


def rooted(forest: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, parent, pre, size of each of ``nodes`` (node, root), with ``forest`` (a, b) as their trees.

    ``pre`` numbers all nodes in depth-first order, children by their ids, so
    the nodes below one are the ``size`` - 1 that follow it. The order comes
    from Euler tours: each edge is two arcs, the arc after u-v is the one after
    v-u among the arcs from v, and the arcs of a tour are placed by doubling
    their steps.
    """
    two = forest.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(forest.select(F.col("b").alias("u"), F.col("a").alias("v")))
    arcs = materialized(numbered(two, "u", "v"), "arcs")
    ends = arcs.groupBy("u").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    back = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("n").alias("rev"))
    arcs = arcs.join(back, ["u", "v"]).join(ends.withColumnRenamed("u", "v"), "v")
    follows = F.when(F.col("rev") < F.col("high"), F.col("rev") + 1).otherwise(F.col("low"))
    starts = nodes.join(ends, nodes["node"] == ends["u"]).where("node = root").select(F.col("root").alias("_r"), F.col("low").alias("start"))
    arcs = arcs.select("n", "u", "v", "rev", follows.alias("next")).join(nodes.select(F.col("node").alias("u"), "root"), "u").join(starts, F.col("root") == F.col("_r"))
    arcs = materialized(arcs.select("n", "u", "v", "rev", "root", F.when(F.col("next") != F.col("start"), F.col("next")).alias("next")), "arcs")
    steps = materialized(arcs.select("n", "next", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("bigint").alias("d")), "steps")
    while not steps.where("next IS NOT NULL").isEmpty():
        steps = materialized(_doubled(_doubled(steps)), "steps")
    left = steps.select("n", "d")  # arcs that follow in the tour
    placed = arcs.select("n", "u", "v", "rev", "root").join(left, "n").join(left.select(F.col("n").alias("rev"), F.col("d").alias("d_rev")), "rev")
    down = placed.where("d > d_rev").select(F.col("v").alias("node"), F.col("u").alias("parent"), (-F.col("d")).alias("at"), ((F.col("d") - F.col("d_rev") + 1) / 2).cast("bigint").alias("size"))
    whole = nodes.groupBy("root").agg(F.count("*").alias("total"))
    all_ = nodes.join(down, "node", "left").join(whole, "root")
    lowest = F.lit(-(1 << 62)).cast("bigint")
    all_ = all_.select("node", "root", "parent", F.coalesce("at", lowest).alias("at"), F.coalesce("size", "total").alias("size"))
    return materialized(numbered(all_, "root", "at", "node", name="pre").select("node", "root", "parent", "pre", "size"), "rooted")


def subtree_extremes(tree: DataFrame, values: DataFrame) -> DataFrame:
    """node, low, high: the least of ``low`` and the greatest of ``high`` (values: node, low, high) over each node and all below it.

    The nodes below one are an interval of ``pre``: two intervals of a power of
    two cover it. Intervals of twice the length come from those before, and
    nodes are done at the power of their own size.
    """
    spans = materialized(tree.join(values, "node").select("pre", "low", "high"), "spans")
    asks = materialized(tree.select("node", "pre", "size", F.floor(F.log2("size") + 1e-9).cast("int").alias("k")), "asks")
    top = asks.agg(F.max("k")).first()[0]
    out = None
    for k in range((top or 0) + 1):
        far = spans.select((F.col("pre")).alias("_p"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        mine = asks.where(F.col("k") == k)
        got = mine.join(spans, "pre").withColumn("_p", F.col("pre") + F.col("size") - (1 << k)).join(far, "_p").select("node", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high"))
        out = got if out is None else out.unionByName(got)
        if k < (top or 0):
            wide = spans.join(far, F.col("pre") + (1 << k) == F.col("_p"), "left")
            spans = materialized(wide.select("pre", F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high")), "spans")
    return out


def subtree_sums(tree: DataFrame, values: DataFrame, *keys: str) -> DataFrame:
    """node, keys, below: the sum of ``values`` (node, keys, v) over each node and all below it; only keys that occur there.

    A value of a node counts for it and all above. Values are placed by
    ``pre`` and summed from the left; a node's sum is the difference at the
    ends of its interval, found where the key changes: each node asks once for
    each key of its tree.
    """
    placed = values.join(tree.select("node", "root", "pre"), "node")
    kinds = placed.select("root", *keys).distinct()
    one = materialized(placed.groupBy("root", *keys, "pre").agg(F.sum("v").alias("v")), "placed")
    asks = tree.join(kinds, "root").select("node", "root", *keys, F.explode(F.array(F.struct((F.col("pre") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("pre") + F.col("size") - 1).alias("at"), F.lit(1).alias("sign")))).alias("q"))
    nothing = F.lit(None).cast("bigint")
    rows = one.select("root", *keys, F.col("pre").alias("at"), F.lit(0).alias("ask"), "v", nothing.alias("node"), F.lit(0).alias("sign"))
    zero = F.lit(0).cast(dict(one.dtypes)["v"])
    rows = rows.unionByName(asks.select("root", *keys, "q.at", F.lit(1).alias("ask"), zero.alias("v"), "node", F.col("q.sign").alias("sign")))
    # running sums within ranges of the order, shifted by the sums of the ranges before
    ranged = materialized(numbered(rows, "root", *keys, "at", "ask", name="n"), "order")
    block = F.floor(F.col("n") / 4096)
    key = F.struct("root", *keys)
    blocks = ranged.groupBy(block.alias("b")).agg(F.sum("v").alias("s"))
    before = materialized(numbered(blocks, "b", name="i"), "blocks")
    shift = before.withColumn("g", F.floor(F.col("i") / 4096))
    groups = shift.groupBy("g").agg(F.sum("s").alias("gs")).withColumn("go", F.coalesce(F.sum("gs").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for 16 million
    shift = shift.join(F.broadcast(groups.select("g", "go")), "g").withColumn("o", F.coalesce(F.sum("s").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("go")).select("b", "o")
    own = Window.partitionBy("b").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.withColumn("b", block).join(shift, "b").withColumn("run", F.sum("v").over(own) + F.col("o")).withColumn("key", key)
    found = run.where("ask = 1").groupBy("node", *keys).agg(F.sum(F.col("run") * F.col("sign")).alias("below"))
    return found.where("below <> 0")
