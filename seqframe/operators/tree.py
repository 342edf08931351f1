"""Trees: paths, distances, characters and parsimony.

A rooted tree is a table of nodes (tree_id, node, parent, ...), the root's parent null.  An
unrooted one is a table of edges (tree_id, u, v), leaves with a sequence each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stages import stage


def children(nodes: DataFrame) -> DataFrame:
    """tree_id, node, children (array) of the nodes that have any."""
    down = nodes.where(F.col("parent").isNotNull())
    return down.groupBy("tree_id", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("children"))


def parents(kids: DataFrame) -> DataFrame:
    """tree_id, node, parent from (tree_id, node, children); an error where a node has two parents."""
    arcs = kids.select("tree_id", F.col("node").alias("parent"), F.explode("children").alias("node"))
    one = arcs.groupBy("tree_id", "node").agg(F.min("parent").alias("parent"), F.count("*").alias("n"))
    checked = F.when(F.col("n") == 1, F.col("parent")).otherwise(F.raise_error(F.lit("not a tree")).cast("int"))
    roots = kids.select("tree_id", "node").join(arcs.select("tree_id", "node"), ["tree_id", "node"], "left_anti")
    return one.select("tree_id", "node", checked.alias("parent")).unionByName(roots.withColumn("parent", F.lit(None).cast("int")))


def closure(nodes: DataFrame) -> DataFrame:
    """tree_id, node, above, steps, dist: every node with itself and each of its ancestors.

    Doubling: each round joins the steps known so far with themselves.  A missing weight counts 0.
    """
    weight = F.coalesce(F.col("weight"), F.lit(0.0)) if "weight" in nodes.columns else F.lit(0.0)
    own = nodes.select("tree_id", "node", F.col("node").alias("above"), F.lit(0).alias("steps"), F.lit(0.0).alias("dist"))
    far = nodes.where(F.col("parent").isNotNull()).select("tree_id", "node", F.col("parent").alias("above"), F.lit(1).alias("steps"), weight.alias("dist"))
    known = stage(own.unionByName(far))
    while True:
        # the farthest ancestors of the last round take over all that is known of theirs
        most = known.withColumn("m", F.max("steps").over(W.partitionBy("tree_id", "node"))).where("steps = m and steps > 0").drop("m")
        up = known.where("steps > 0").select("tree_id", F.col("node").alias("above"), F.col("above").alias("a2"), F.col("steps").alias("s2"), F.col("dist").alias("d2"))
        more = most.join(up, ["tree_id", "above"]).select("tree_id", "node", F.col("a2").alias("above"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("dist") + F.col("d2")).alias("dist"))
        more = stage(more)
        if not more.limit(1).count():
            return known
        known = stage(known.unionByName(more))


def pair_paths(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """tree_id, a, b, steps, dist of the ``wanted`` pairs; null when they are not connected."""
    up = closure(nodes)
    a = up.select("tree_id", F.col("node").alias("a"), "above", F.col("steps").alias("sa"), F.col("dist").alias("da"))
    b = up.select("tree_id", F.col("node").alias("b"), "above", F.col("steps").alias("sb"), F.col("dist").alias("db"))
    met = wanted.join(a, ["tree_id", "a"]).join(b, ["tree_id", "b", "above"])
    near = met.groupBy("tree_id", "a", "b").agg(
        F.min(F.struct((F.col("sa") + F.col("sb")).alias("steps"), (F.col("da") + F.col("db")).alias("dist"))).alias("m")
    )
    return wanted.join(near, ["tree_id", "a", "b"], "left").select("tree_id", "a", "b", "m.steps", "m.dist")


def leaf_distances(nodes: DataFrame) -> DataFrame:
    """tree_id, a, b, dist of all pairs of leaves a < b: the matrix itself is quadratic in the leaves."""
    inner = nodes.select("tree_id", F.col("parent").alias("node")).where("node is not null").distinct()
    leaf = stage(nodes.join(inner, ["tree_id", "node"], "left_anti").select("tree_id", "node"))
    pairs = leaf.withColumnRenamed("node", "a").join(leaf.withColumnRenamed("node", "b"), "tree_id").where("a < b")
    return pair_paths(nodes, pairs).select("tree_id", "a", "b", "dist")


def name_map(nodes: DataFrame) -> DataFrame:
    """tree_id, name, node of the named nodes; of equal names the greatest node."""
    return nodes.where(F.coalesce("name", F.lit("")) != "").groupBy("tree_id", "name").agg(F.max("node").alias("node"))


def characters(nodes: DataFrame) -> DataFrame:
    """tree_id, node, bits: for each arc to an inner node the nodes below it, node 0 rightmost.

    A root with a single child does not count as one; arcs from it neither.
    """
    kids = nodes.where("parent is not null").groupBy("tree_id", F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    all_ = nodes.join(kids, ["tree_id", "node"], "left")
    single = all_.where("parent is null and kids = 1").select("tree_id", F.col("node").alias("parent"))
    inner = all_.where("parent is not null and kids > 0").join(single, ["tree_id", "parent"], "left_anti").select("tree_id", "node")
    below = closure(nodes).select("tree_id", F.col("above").alias("node"), F.col("node").alias("low"))
    sets = inner.join(below, ["tree_id", "node"]).groupBy("tree_id", "node").agg(F.collect_set("low").alias("low"))
    n = nodes.groupBy("tree_id").agg(F.max("node").alias("top"))
    bits = F.transform(F.sequence(F.col("top"), F.lit(0)), lambda i: F.when(F.array_contains("low", i), "1").otherwise("0"))
    return sets.join(n, "tree_id").select("tree_id", "node", F.array_join(bits, "").alias("bits"))


def site_characters(seqs: DataFrame) -> DataFrame:
    """pos, bits: places where at least two of four or more equal-length sequences differ from the modal symbol.

    Sequences are in order of id, the first rightmost.  Of equally frequent symbols the one that
    reached its count first is modal.
    """
    from .kmers import symbols

    checked = seqs.agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"))
    fit = checked.where("n >= 4 and lo = hi and lo > 0").select("n")
    each = symbols(seqs).join(F.broadcast(fit))
    held = each.groupBy("pos", "sym", "n").agg(F.count("*").alias("c"), F.max("id").alias("last"))
    modal = held.groupBy("pos", "n").agg(F.max_by("sym", F.struct("c", -F.col("last"))).alias("modal"), F.max("c").alias("mode")).where("n - mode >= 2")
    bits = each.join(modal.select("pos", "modal"), "pos").groupBy("pos").agg(
        F.array_sort(F.collect_list(F.struct(F.col("id"), F.when(F.col("sym") == F.col("modal"), "0").otherwise("1").alias("b")))).alias("x")
    )
    return bits.select("pos", F.array_join(F.reverse(F.transform("x", lambda v: v["b"])), "").alias("bits"))


def max_parsimony(nodes: DataFrame) -> DataFrame:
    """tree_id, node, parent, seq, cost of rooted trees (tree_id, node, parent, seq of the leaves).

    The least number of changes, place by place; of equal choices the parent's base, then the
    first of A, C, T, G.  A tree is one search, trees run apart.
    """

    def run(table):
        from ..functions.parsimony import rooted

        return rooted(table)

    kind = nodes.schema["tree_id"].dataType.simpleString()
    rows = nodes.select("tree_id", F.col("node").cast("int"), F.col("parent").cast("int"), "seq")
    return rows.groupBy("tree_id").applyInPandas(run, f"tree_id {kind}, node int, parent int, seq string, cost int")


def max_parsimony_unrooted(edges: DataFrame, leaves: DataFrame, improve: bool = False) -> DataFrame:
    """tree_id, u, v, seq_u, seq_v, cost of each edge; ``improve`` swaps neighbouring subtrees while that lowers the total.

    edges: (tree_id, u, v); leaves: (tree_id, node, seq).  A tree is one search, trees run apart.
    """

    def run(key, arcs, tips):
        from ..functions.parsimony import unrooted

        return unrooted(key[0], arcs, tips, improve)

    kind = edges.schema["tree_id"].dataType.simpleString()
    tips = leaves.select(F.col("tree_id").alias("tip_tree"), "node", "seq")
    return edges.select("tree_id", "u", "v").groupBy("tree_id").cogroup(tips.groupBy("tip_tree")).applyInPandas(
        run, f"tree_id {kind}, u int, v int, seq_u string, seq_v string, cost int"
    )


def swap_edges(edges: DataFrame, a: int, ax: int, b: int, bx: int) -> DataFrame:
    """The edges after the subtree ax of node a and the subtree bx of node b changed places; labels move along."""
    u, v = F.col("u"), F.col("v")

    def end(x, other):
        return (
            F.when((x == a) & (other == ax), b).when((x == b) & (other == bx), a).otherwise(x)
        )

    return edges.withColumns({"u": end(u, v), "v": end(v, u)})


def sub_trees(edges: DataFrame, a: int, b: int) -> DataFrame:
    """end, node: the neighbours of a and of b other than each other."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where(F.col("u").isin(a, b) & ~F.col("v").isin(a, b)).select(F.col("u").alias("end"), F.col("v").alias("node"))
